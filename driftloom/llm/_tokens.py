"""Exact ids of whole texts from a public tokenizer file, with a cache by word."""

from __future__ import annotations

import ctypes
import gc
import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

#: White space other than the four plain kinds: such texts are encoded as a whole.
ODD_ASCII = "\x0b\x0c\x1c\x1d\x1e\x1f"
ODD_SPACE = ODD_ASCII + "\x85\xa0                　"
#: Words that a worker keeps encoded; later words are encoded each time they occur.
CACHED_WORDS = 690_000
#: A pre-tokenizer always parts such a mark from a letter before it.
MARKS = frozenset(".,;:!?")


class WordCache(dict):
    """Little-endian uint32 ids by word. A pre-tokenizer never joins a word to what follows white space, so a
    text's ids are its words' ids one after the other. A last mark is looked up by itself, and so, where the
    tokenizer lowers letters, is a word of Latin letters in lower case: most new words are known ones so varied."""

    def __init__(self, tokenizer, lowers: bool, most: int = CACHED_WORDS):
        super().__init__()
        self.tokenizer, self.lowers, self.most = tokenizer, lowers, most

    def __missing__(self, word: str) -> bytes:
        if len(word) > 1 and word[-1] in MARKS and word[-2].isalpha():
            ids = self[word[:-1]] + self[word[-1]]
        elif self.lowers and word != (low := word.lower()) and max(word) < "\u0180" and "\u0130" not in word:
            ids = self[low]
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < self.most:
            self[word] = ids
        return ids


class Encoder:
    """``encode(text)`` gives ids as little-endian uint32 bytes, the same as the tokenizers library for the whole text.

    ``byte_bpe_50k.json`` keeps white space with the word after it; ``word_bpe_49k.json`` drops it. A text with the
    string of an added token, in whatever case, goes to the library as a whole. None is the empty text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        keeps_space = ids("a b") != ids("a  b")
        self.cache = WordCache(self.tokenizer, lowers=ids("AbC") == ids("abc"))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search if added else None
        #: A mark that all of these have, which hardly any text has; no normalizer makes it from others.
        self.mark = next((c for c in "|<>[]{}#@" if all(c in t for t in added)), "")
        self.words = re.compile(r"\s*\S+|\s+").findall if keeps_space else str.split

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in (ODD_ASCII if text.isascii() else ODD_SPACE)) or (self.added and self.mark in text and self.added(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.cache.__getitem__, self.words(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder by path in each worker process, so its cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Lets go of the encoder that a worker keeps, where the worker goes on with other work, and of memory that is
    free but not returned. An encoder and its cache may take some hundred MB, in each worker of an executor."""
    if not _ENCODERS:
        return
    _ENCODERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def encoded(path: str, texts: Iterable[str | None], end_id: int | None) -> Iterable[bytes]:
    e, end = encoder(path).encode, b"" if end_id is None else int(end_id).to_bytes(4, "little")
    return (e(x) + end for x in texts)
