"""Substring dedup by relative Lempel-Ziv parsing.

A document is factored against every earlier text of the corpus. The reference is an index of the windows of
``window`` words at their earliest place, cut into blocks: a window belongs to the block of its anchor, the least
5-word hash in it, so equal windows always meet in one block and neighbouring windows mostly share a block and
travel as one row; an anchor of very many places is left out, and each of its windows is a block of its own. Anchors
are counted first, and windows of an anchor that occurs once aren't sent at all. Windows of one anchor are told apart
by 64-bit hashes of their words: by chance, n different windows of one anchor hold n * n / 2 ** 65 pairs taken for
equal. A window found earlier elsewhere is the seed of a factor; seeds in a row that keep the same distance to their
source are one factor. The document is then parsed greedily, at each word taking the factor that reaches furthest; as
each factor is checked from the start of its match and not from the last factor's end, no match of ``window`` words is
lost at a boundary.

Windows that repeat within a block of documents that a task reads together are settled there, so a passage that
many documents share is sent once for each such block and not once for each document.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import id_back, id_key, stage
from ._words import mix, rolling, word_hashes

SEED = 5
#: Places of an anchor beyond which its windows are dealt one by one, so that none has many in its task.
OFTEN = 1_000
#: log2 of the bits that tell which anchors occur again, at most.
MOST_BITS = 27
#: Words that a task looks at together.
BLOCK_WORDS = 600_000
_ROW = "key long, doc long, start int, data binary"
_SPAN = struct.Struct("<iqi")


def _runs(doc: np.ndarray, pos: np.ndarray, src_doc: np.ndarray, src_pos: np.ndarray) -> np.ndarray:
    """First index of each run of windows that follow each other and keep their distance to their source."""
    if not len(doc):
        return np.empty(0, np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (src_doc[1:] != src_doc[:-1]) | (src_pos[1:] != src_pos[:-1] + 1)
    return np.flatnonzero(new)


def _anchored(docs: list[tuple[int, list[bytes]]], window: int):
    """Of all windows of the documents: their starts and anchors among the documents' words in a row, and the hash of
    each seed of SEED words; with the words' hashes and each document's size and place. None if there is no window."""
    docs.sort(key=lambda d: d[0])
    sizes = np.array([len(w) for _, w in docs])
    if not len(sizes) or sizes.max() < window:
        return None
    hashes = word_hashes([x for _, w in docs for x in w])
    at = np.cumsum(sizes) - sizes
    starts = np.concatenate([np.arange(a, a + n - window + 1) for a, n in zip(at, sizes, strict=True) if n >= window])
    seeds = rolling(hashes, SEED)
    anchor = starts + np.lib.stride_tricks.sliding_window_view(seeds, window - SEED + 1)[starts].argmin(1)
    return hashes, sizes, at, starts, seeds, anchor


def _held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    top = np.uint64(64 - (len(bits) * 32).bit_length() + 1)
    x, y = keys >> top, mix(keys) >> top
    return ((bits[x >> np.uint64(5)] >> (x & np.uint64(31)).astype(np.uint32)) & (bits[y >> np.uint64(5)] >> (y & np.uint64(31)).astype(np.uint32)) & 1).astype(bool)


def _index(docs: list[tuple[int, list[bytes]]], window: int, again: np.ndarray | None = None, often: np.ndarray | None = None) -> pa.RecordBatch | None:
    """Rows to be dealt by key: windows not seen in these documents before (data: 64-bit hashes), and, with a start
    below 0, factors found among them (data: windows, source, its start). The key is a window's anchor, or where the
    anchor is among the bits ``often`` the window itself; windows of anchors that aren't among ``again`` stay away."""
    if (found := _anchored(docs, window)) is None:
        return None
    hashes, sizes, at, starts, seeds, anchor = found
    whole = rolling(hashes, window)[starts]
    of = np.repeat(np.arange(len(docs)), np.maximum(0, sizes - window + 1))
    doc, pos = np.array([d for d, _ in docs], np.int64)[of], (starts - at[of]).astype(np.int64)
    _, first, which = np.unique(whole, return_index=True, return_inverse=True)
    first = first[which]
    new = first == np.arange(len(first))
    old = ~new & ~((doc[first] == doc) & (pos[first] == pos))

    o = np.flatnonzero(old)
    r = _runs(doc[o], pos[o], doc[first[o]], pos[first[o]])
    n = np.diff(np.append(r, len(o)))
    o = o[r]
    spans = [_SPAN.pack(*x) for x in zip(n.tolist(), doc[first[o]].tolist(), pos[first[o]].tolist(), strict=True)]
    span_key = mix(doc[o].view(np.uint64) ^ mix(pos[o].view(np.uint64) + np.uint64(1)))

    key = seeds[anchor]
    if again is not None:
        new &= _held(again, key)
    if often is not None:
        key = np.where(_held(often, key), mix(whole), key)
    i = np.flatnonzero(new)
    cut = np.ones(len(i), bool)
    cut[1:] = (np.diff(i) != 1) | (key[i][1:] != key[i][:-1]) | (of[i][1:] != of[i][:-1])
    c = np.flatnonzero(cut)
    raw = whole[i].astype("<u8").tobytes()
    ends = 8 * np.append(c[1:], len(i))
    data = [raw[a:b] for a, b in zip((8 * c).tolist(), ends.tolist(), strict=True)]
    i = i[c]
    return pa.RecordBatch.from_pydict(
        {
            "key": pa.array(np.concatenate([key[i], span_key]).view(np.int64)),
            "doc": pa.array(np.concatenate([doc[i], doc[o]])),
            "start": pa.array(np.concatenate([pos[i], -1 - pos[o]]).astype(np.int32)),
            "data": pa.array(data + spans, pa.binary()),
        }
    )


def _bits(keys: DataFrame) -> np.ndarray:
    """Two bits for each key (long), about 16 times as many in all, gathered as words of 32; beyond MOST_BITS their
    number stays, and they only tell less keys apart."""
    size = min(MOST_BITS, max(10, (16 * keys.count()).bit_length()))
    # The same bits as those of _held: the top ones of the key and of its mix.
    top = keys.select("key").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"x": pa.array(np.concatenate([k, mix(k)]) >> np.uint64(64 - size), pa.uint64()).cast(pa.int64())}) for b in batches for k in [b.column(0).to_numpy().view(np.uint64)]), "x long")
    words = top.groupBy(F.shiftright("x", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 31 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (size - 5), np.uint32)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint32)
    return out


def _seek(batches):
    """Over rows sorted by key, doc and start: the factors of what isn't the first of its kind. Holds a batch and
    the distinct windows of one key."""
    none = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    last, carried = None, none
    for b in batches:
        if not b.num_rows:
            continue
        key, doc, start = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
        data = b.column(3).to_pylist()
        out = []
        if len(s := np.flatnonzero(start < 0)):
            got = [_SPAN.unpack(data[k]) for k in s.tolist()]
            out.append((doc[s], -1 - start[s].astype(np.int64), *(np.array(x, np.int64) for x in zip(*got, strict=True))))
        if len(k := np.flatnonzero(start >= 0)):
            held = [data[x] for x in k.tolist()]
            sizes = np.array([len(x) // 8 for x in held])
            kk = np.repeat(key[k], sizes)
            w = mix(kk.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.frombuffer(b"".join(held), "<u8")))
            d = np.repeat(doc[k], sizes)
            p = np.arange(len(kk)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start[k].astype(np.int64), sizes)
            skip = 0
            if last is not None and kk[0] == last:
                w, d, p = (np.concatenate(x) for x in zip(carried, (w, d, p), strict=True))
                skip = len(carried[0])
                kk = np.concatenate([np.full(skip, last, np.int64), kk])
            _, first, which = np.unique(w, return_index=True, return_inverse=True)
            first = first[which]
            old = ~((d[first] == d) & (p[first] == p))
            old[:skip] = False
            o = np.flatnonzero(old)
            r = _runs(d[o], p[o], d[first[o]], p[first[o]])
            n = np.diff(np.append(r, len(o)))
            o = o[r]
            out.append((d[o], p[o], n, d[first[o]], p[first[o]]))
            last = kk[-1]
            stay = np.flatnonzero((kk == last) & (first == np.arange(len(kk))))
            carried = (w[stay], d[stay], p[stay])
        if out:
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc": pa.array(cols[0]), "start": pa.array(cols[1].astype(np.int32)), "n": pa.array(cols[2].astype(np.int32)), "src_doc": pa.array(cols[3]), "src_start": pa.array(cols[4].astype(np.int32))})


def parse(matches: list[tuple[int, int, int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, end, src_doc, src_start) of one document from its matches (start, windows, src_doc,
    src_start): at each word the match that reaches furthest; words of no match belong to none."""
    joined: dict[tuple[int, int], list[list[int]]] = {}
    for start, n, src, src_start in sorted(matches):
        line = joined.setdefault((src, src_start - start), [])
        if line and start <= line[-1][1] - window + 1:
            line[-1][1] = max(line[-1][1], start + n + window - 1)
        else:
            line.append([start, start + n + window - 1])
    lines = sorted((a, b, src, a + off) for (src, off), line in joined.items() for a, b in line)
    out: list[tuple[int, int, int, int]] = []
    at, k, best = 0, 0, None
    while k < len(lines) or (best and best[1] > at):
        while k < len(lines) and lines[k][0] <= at:
            if best is None or lines[k][1] > best[1]:
                best = lines[k]
            k += 1
        if best and best[1] > at:
            begin = max(at, best[0])
            out.append((begin, best[1], best[2], best[3] + begin - best[0]))
            at = best[1]
        elif k < len(lines):
            at = lines[k][0]
    return out


def substring_dedup(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Removes each word covered by a window of ``window`` words whose word sequence also starts earlier (at a smaller
    doc_id, or earlier in the same document); what counts is the input, not what is left of it.

    Returns one row per row: doc_id, n_words, n_removed, kept_sha256, factors (start, end, src_doc, src_start: the
    greedy parse, in words) and with ``with_text`` kept_text. NULL or empty text has no words; texts shorter than a
    window are kept; a NULL doc_id comes before all others. doc_id names a document: rows that repeat both doc_id
    and text are one document and give equal rows; rows that repeat a doc_id with another text share the parse of
    their positions, so give such rows ids of their own. An empty table gives no rows."""

    def blocks(batches):
        held: list[tuple[int, list[bytes]]] = []
        n = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = text.split() if text else []
                held.append((doc, words))
                n += len(words)
                if n >= BLOCK_WORDS:
                    yield held
                    held, n = [], 0
        yield held

    def count(batches):
        for held in blocks(batches):
            if (found := _anchored(held, window)) is not None:
                key, n = np.unique(found[4][np.unique(found[5])], return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    def index(batches):
        again, often = bits.value
        for held in blocks(batches):
            if (out := _index(held, window, again, often)) is not None:
                yield out

    def cut(batches):
        for b in batches:
            rows = []
            for doc, text, found in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                words = text.split() if text else []
                n = len(words)
                factors = parse([(m["start"], m["n"], m["src_doc"], m["src_start"]) for m in found], window) if found else []
                for a, z, _, _ in reversed(factors):
                    del words[a:z]
                kept = b" ".join(words)
                rows.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), [dict(zip(("start", "end", "src_doc", "src_start"), f, strict=True)) for f in factors], kept.decode() if with_text else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            factor = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("src_doc", pa.int64()), ("src_start", pa.int32())]))
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), factor, pa.string()), strict=True)]
            names = ["doc", "n_words", "n_removed", "kept_sha256", "factors", "kept_text"]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_text], names[: 5 + with_text])

    rows = docs.select(id_key(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    counts = stage(rows.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1"), "anchors")
    bits = docs.sparkSession.sparkContext.broadcast((_bits(counts), _bits(counts.filter(F.col("n") > OFTEN))))
    dealt = rows.mapInArrow(index, _ROW).repartition("key").sortWithinPartitions("key", "doc", "start")
    found = dealt.mapInArrow(_seek, "doc long, start int, n int, src_doc long, src_start int")
    by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "src_doc", "src_start")).alias("found"))
    joined = rows.join(by_doc, "doc", "left").select("doc", "text", "found")
    schema = "doc long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start: int, end: int, src_doc: long, src_start: int>>" + ", kept_text string" * with_text
    out = joined.mapInArrow(cut, schema)
    back = F.transform("factors", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), F.nullif(f["src_doc"], F.lit(-(2**63))).alias("src_doc"), f["src_start"].alias("src_start")))
    return out.select(id_back("doc").alias("doc_id"), "n_words", "n_removed", "kept_sha256", back.alias("factors"), *(["kept_text"] if with_text else []))
