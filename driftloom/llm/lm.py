"""Language-model scoring by cross-entropy difference.

Two bigram models, one of target documents and one of the whole corpus, share one vocabulary: every word of the corpus.
Both are smoothed by a Dirichlet prior around their unigrams (MacKay and Peto). A document's score is the mean over its
words of target loss less background loss: low means like the target.

No table of words or bigrams is held in one place. Documents are put into chunks of a bounded number of words, and a
chunk counts each of its different bigrams and words once. Counts are dealt by hash into buckets, in one compressed
block for each chunk and bucket; a bucket adds them up and answers each block with totals in the block's own order. A
chunk so learns the counts of what it holds, and scores its documents by them. A word or bigram that is in every
document has one count for each chunk, never one for each place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import stage
from ._words import mix, word_hashes

#: Weight of the unigrams in each context, in words.
PRIOR = 50.0
#: Words and documents after which a chunk ends; a longer document is a chunk by itself.
CHUNK_WORDS, CHUNK_DOCS = 2_000_000, 100_000
#: Words of the corpus for each bucket.
BUCKET_WORDS = 2_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Stands before a text's first word; no word is empty, so no word has this hash by rule.
_START = word_hashes([b""])
_CHUNKS = "chunk long, n long, docs array<long>, lens array<int>, ids binary, words binary"
_BLOCKS = "kind int, bucket long, chunk long, keys binary, total binary, target binary"
_TOTALS = "chunk long, kind int, bucket long, total binary, target binary, kinds long, sum_total long, sum_target long"


class _Local(dict):
    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        return k


def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed together."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def _unpack(b: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return raw.reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).ravel()


def _chunks(batches):
    """Documents as ids local to their chunk, with the hash of each id's word."""
    part, made = TaskContext.get().partitionId(), 0
    local, docs, lens, ids, held = _Local(), [], [], [], 0

    def out():
        x = np.concatenate(ids) if ids else np.empty(0, np.int32)
        row = {"chunk": [part << 32 | made], "n": [held], "docs": pa.array([docs], pa.list_(pa.int64())), "lens": pa.array([lens], pa.list_(pa.int32())), "ids": pa.array([_pack(x)], pa.binary()), "words": pa.array([word_hashes(list(local)).tobytes()], pa.binary())}
        return pa.RecordBatch.from_pydict(row)

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            words = (text.as_py() or b"").split()
            if docs and (held + len(words) > CHUNK_WORDS or len(docs) >= CHUNK_DOCS):
                yield out()
                made += 1
                local, docs, lens, ids, held = _Local(), [], [], [], 0
            docs.append(doc)
            lens.append(len(words))
            ids.append(np.fromiter(map(local.__getitem__, words), np.int32, len(words)))
            held += len(words)
    if docs:
        yield out()


class _Chunk:
    """A chunk's different bigrams (kind 0) and words (kind 1) in the order of their keys."""

    def __init__(self, table: pa.Table):
        self.docs = table.column("docs").combine_chunks().flatten()
        self.lens = table.column("lens").combine_chunks().flatten().to_numpy().astype(np.int64)
        self.ids = _unpack(table.column("ids")[0].as_py(), np.int32)
        words = np.frombuffer(table.column("words")[0].as_py(), np.uint64)
        self.first = (np.cumsum(self.lens) - self.lens)[self.lens > 0]
        prev = np.empty(len(self.ids), np.int64)
        prev[1:] = self.ids[:-1]
        prev[self.first] = len(words)
        pairs, at = np.unique(prev << 32 | self.ids, return_inverse=True)
        h = np.concatenate([words, _START])
        keys = mix(h[pairs >> 32] * _FACTOR + h[pairs & 0xFFFFFFFF])
        order, place = np.argsort(keys), np.argsort(words)
        self.keys = keys[order], words[place]
        del h, keys, prev
        self.word_place = np.empty(len(words), np.int64)
        self.word_place[place] = np.arange(len(words))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        #: Place of each word's bigram and word.
        self.at = rank[at], self.word_place[self.ids]
        #: Local ids of each bigram's words, in the order of keys.
        self.before, self.word = pairs[order] >> 32, pairs[order] & 0xFFFFFFFF


def _blocks(buckets: int):
    """Counts of a chunk, for all its documents and for its target documents, in a block for each bucket."""

    def run(key, chunk, marks):
        if not chunk.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in _schema(_BLOCKS)}, _schema(_BLOCKS))
        c = _Chunk(chunk)
        target = np.zeros(len(c.lens), bool)
        if marks.num_rows:
            target[marks.column("at").combine_chunks().flatten().to_numpy()] = True
        target = np.repeat(target, c.lens)
        rows = []
        for kind, (keys, at) in enumerate(zip(c.keys, c.at, strict=True)):
            counts = [np.bincount(x, minlength=len(keys)).astype(np.uint32) for x in (at, at[target])]
            bucket = _bucket(keys, buckets)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]]) if len(keys) else [0]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                gaps = np.diff(keys[lo:hi], prepend=np.uint64(0))
                rows.append((kind, int(bucket[lo]), key[0].as_py(), _pack(gaps), *(_pack(n[lo:hi]) for n in counts)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.table([pa.array(v, f.type) for v, f in zip(cols, _schema(_BLOCKS), strict=True)], _schema(_BLOCKS))

    return run


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _schema(ddl: str) -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, types[t]) for name, t in (x.split() for x in ddl.split(", "))])


def _totals(key, blocks):
    """Totals of a bucket's keys, for each block in its order, and a row of sums (chunk NULL)."""
    keys = [np.cumsum(_unpack(b.as_py(), np.uint64), dtype=np.uint64) for b in blocks.column("keys")]
    sizes = [len(k) for k in keys]
    keys = np.concatenate(keys)
    kinds, at = np.unique(keys, return_inverse=True)
    del keys
    sums = []
    for name in ("total", "target"):
        s = np.zeros(len(kinds), np.int64)
        np.add.at(s, at, np.concatenate([_unpack(b.as_py(), np.uint32) for b in blocks.column(name)]))
        sums.append(s)
    rows, lo = [], 0
    kind, bucket = key[0].as_py(), key[1].as_py()
    for chunk, size in zip(blocks.column("chunk").to_pylist(), sizes, strict=True):
        place = at[lo : lo + size]
        rows.append((chunk, kind, bucket, *(_pack(s[place]) for s in sums), 0, 0, 0))
        lo += size
    rows.append((None, kind, bucket, None, None, len(kinds), int(sums[0].sum()), int(sums[1].sum())))
    return pa.table([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _schema(_TOTALS), strict=True)], _schema(_TOTALS))


def losses(pair: np.ndarray, before: np.ndarray, word: np.ndarray, words: int, kinds: int, prior: float) -> np.ndarray:
    """-ln P(word | before) of bigrams: (c(ab) + prior P(b)) / (c(a) + prior), where P(b) adds one to each count."""
    return np.log(before + prior) - np.log(pair + prior * ((word + 1) / (words + kinds)))


def _scores(kinds: int, words: tuple[int, int], texts: tuple[int, int], prior: float):
    def run(key, chunk, totals):
        if not chunk.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("n_words", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()))})
        c = _Chunk(chunk)
        totals = totals.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        of = np.array(totals.column("kind").to_pylist(), np.int64)
        n = c.lens
        out = []
        for name, all_words, all_texts in zip(("total", "target"), words, texts, strict=True):
            blocks = [_unpack(b.as_py(), np.int64) for b in totals.column(name)]
            pair, word = (np.concatenate([np.empty(0, np.int64), *(b for b, k in zip(blocks, of, strict=True) if k == kind)]) for kind in (0, 1))
            by_id = np.concatenate([word[c.word_place], [all_texts]])
            loss = losses(pair, by_id[c.before], by_id[c.word], all_words, kinds, prior)
            mean = np.full(len(n), np.nan)
            if len(c.first):
                mean[n > 0] = np.add.reduceat(loss[c.at[0]], c.first) / n[n > 0]
            out.append(pa.array(mean, pa.float64(), mask=n == 0))
        return pa.table({"doc_id": c.docs, "n_words": pa.array(n, pa.int64()), "target_loss": out[1], "background_loss": out[0]})

    return run


def lm_scores(docs: DataFrame, target_ids: DataFrame, *, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, target_loss, background_loss, score (nats a word).

    ``target_ids`` has a column like ``id_col``; ids in it that no document has don't matter, nor do repeated or NULL
    ids. A text without words, or NULL, has 0 words and NULL losses; rows that repeat a doc_id each count and get a
    row; a row without an id is no target document and is scored; without any target document the target model is
    uniform; an empty table gives no rows. Texts are taken whole; a task holds one chunk, so the longest text bounds it
    where that is longer than CHUNK_WORDS. Words and bigrams are told apart by 64-bit hashes."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    chunks = stage(rows.mapInArrow(_chunks, _CHUNKS), "chunks")
    wanted = target_ids.select(F.col(id_col).cast("long").alias("doc_id")).dropna().distinct().withColumn("target", F.lit(1))
    placed = chunks.select("chunk", F.posexplode("docs").alias("at", "doc_id"), "lens")
    placed = placed.select("chunk", "at", "doc_id", (F.get("lens", "at") > 0).alias("has_words")).filter("has_words")
    # By merge at every size: how ids and documents meet shouldn't turn on how many ids there are.
    marked = stage(placed.select("chunk", "at", "doc_id").filter("doc_id is not null").join(wanted.hint("merge"), "doc_id").select("chunk", "at"), "marks")
    size = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("lens", lambda x: x > 0))), F.lit(0))).first()
    buckets = 1 + size[0] // BUCKET_WORDS
    marks = marked.groupBy("chunk").agg(F.collect_list("at").alias("at"))
    blocks = chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_blocks(buckets), _BLOCKS)
    totals = stage(blocks.groupBy("kind", "bucket").applyInArrow(_totals, _TOTALS), "totals")
    sums = totals.filter("chunk is null and kind = 1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("kinds", "sum_total", "sum_target"))).first()
    answers = totals.filter("chunk is not null").select("chunk", "kind", "bucket", "total", "target")
    run = _scores(sums[0], (sums[1], sums[2]), (size[1], marked.count()), prior)
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, "doc_id long, n_words long, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
