"""Pattern packing by non-negative least squares.

Documents become pieces of at most ``size`` tokens. What the driver sees is the histogram of piece lengths, which
has ``size`` bins at most. Patterns of a few lengths that fill a sequence are enumerated, their repeat counts are
fitted to the histogram by an active-set non-negative least squares, rounded so that no length is used more often
than it occurs, and what is left is packed best fit first, the longest ahead. The plan says which ranks of which length go where;
pieces get ranks without any group of equal lengths meeting in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import id_back, id_key, stage
from ._tokens import encoded

PIECES_A_BUCKET = 50_000


def patterns(lengths: np.ndarray, size: int, depth: int = 3) -> np.ndarray:
    """All descending patterns of up to ``depth`` of the lengths that sum to ``size``; unused parts are 0."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    out = [(size, 0, 0)] if have[size] else []
    for a in sorted((x for x in lengths.tolist() if x < size), reverse=True):
        if depth >= 2 and a >= size - a and have[size - a]:
            out.append((a, size - a, 0))
        if depth >= 3:
            rest = size - a
            b = np.arange(max(1, (rest + 1) // 2), min(a, rest - 1) + 1)
            b = b[have[b] & have[rest - b]]
            out += [(a, int(x), int(rest - x)) for x in b]
    return np.array(out, np.int64).reshape(-1, 3)


def nnls(pats: np.ndarray, histogram: np.ndarray, *, rounds: int = 40, at_once: int = 96, most: int = 1200) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares of repeat counts: minimises |A x - histogram| where column j of A counts the
    lengths of pattern j. Each round adds the patterns with the steepest gradient that share no length, then solves
    on the active set and drops what became negative. Returns (active patterns, repeat counts)."""
    size = len(histogram) - 1
    active: list[int] = []
    x = np.zeros(0)
    h = histogram.astype(float).copy()
    h[0] = 0

    def column(j):
        return np.bincount(pats[j], minlength=size + 1).astype(float) * (np.arange(size + 1) > 0)

    A = np.zeros((size + 1, 0))
    for _ in range(rounds):
        left = h - A @ x
        left[0] = 0
        slope = left[pats].sum(1)
        order = np.argsort(-slope, kind="stable")[: 40 * at_once]
        used, fresh, have = np.zeros(size + 1, bool), [], set(active)
        for j in order.tolist():
            if slope[j] <= 1e-6 or len(fresh) >= at_once:
                break
            parts = [p for p in pats[j].tolist() if p]
            if j in have or used[parts].any():
                continue
            used[parts] = True
            fresh.append(j)
        if not fresh or len(active) + len(fresh) > most:
            break
        active += fresh
        A = np.column_stack([A, *map(column, fresh)])
        while len(active):
            G = A.T @ A
            G[np.diag_indices_from(G)] += 1e-9
            x = np.linalg.solve(G, A.T @ h)
            keep = x > 1e-9
            if keep.all():
                break
            active, A, x = [j for j, k in zip(active, keep, strict=True) if k], A[:, keep], x[keep]
        if np.abs(h - A @ x).sum() < 0.5:
            break
    return pats[active], x


def best_fit(counts: dict[int, int], size: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing over a histogram: patterns and how often each is used."""
    bins: list[dict[tuple[int, ...], int]] = [defaultdict(int) for _ in range(size + 1)]
    for length in sorted(counts, reverse=True):
        c = counts[length]
        room = length
        while c and room <= size:
            if not bins[room]:
                room += 1
                continue
            pattern, n = bins[room].popitem()
            k = min(n, c)
            if n > k:
                bins[room][pattern] = n - k
            bins[room - length][(*pattern, length)] += k
            c -= k
            room = length if room - length >= length else room
        m = size // length
        if c // m:
            bins[size - m * length][(length,) * m] += c // m
        if c % m:
            bins[size - (c % m) * length][(length,) * (c % m)] += 1
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for b in bins:
        for pattern, n in b.items():
            out[pattern] += n
    return out


#: Shares of the fitted counts that are fixed; what is left goes to the residual packing.
SHARES = (1.0, 0.9, 0.7, 0.4, 0.1)


def plan(histogram: dict[int, int], size: int, depth: int = 3) -> dict[tuple[int, ...], int]:
    """Patterns and repeat counts that use every piece once. The fitted counts are rounded at several shares of them,
    since the fit can use up lengths that the residual needs; of the plans, the one of fewest sequences is taken."""
    whole = {k: v for k, v in histogram.items() if v}
    if not whole:
        return {}
    h = np.zeros(size + 1, np.int64)
    for k, v in whole.items():
        h[k] = v
    found, x = nnls(patterns(np.array(sorted(whole)), size, depth), h)
    plans = []
    for share in SHARES:
        left, out = dict(whole), defaultdict(int)
        for j in np.argsort(-x, kind="stable").tolist():
            parts = [p for p in found[j].tolist() if p]
            need = {p: parts.count(p) for p in parts}
            k = min(int(round(share * x[j])), *(left.get(p, 0) // n for p, n in need.items()))
            if k > 0:
                out[tuple(parts)] += k
                for p, n in need.items():
                    left[p] -= k * n
        for pattern, n in best_fit({k: v for k, v in left.items() if v}, size).items():
            out[pattern] += n
        plans.append(out)
    return min(plans, key=lambda p: sum(p.values()))


def slots(packed: dict[tuple[int, ...], int]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first rank, offset): a pattern's repeats are sequences in a
    row, and each of its parts takes as many ranks of its length."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in sorted(packed.items()):
        offset = 0
        for length in pattern:
            rows.append((length, used[length], used[length] + n - 1, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return rows


def pieces(docs: DataFrame, tokenizer_path: str, *, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, with_ids: bool = False) -> DataFrame:
    """Token pieces of each document: those over ``size`` tokens are cut so that all but the first piece are full."""

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for doc_id, raw in zip(b.column(0).to_pylist(), encoded(tokenizer_path, b.column(1).to_pylist(), end_id), strict=True):
                n = len(raw) // 4
                at, end = 0, n % size or min(n, size)
                for k in range((n + size - 1) // size):
                    part = raw[4 * at : 4 * end]
                    rows.append((doc_id, k, at, end - at, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None))
                    at, end = end, end + size
            for k in range(0, len(rows), 20_000):
                cols = list(zip(*rows[k : k + 20_000], strict=True))
                data = {"doc_id": pa.array(cols[0], pa.int64()), "piece": pa.array(cols[1], pa.int32())} | {c: pa.array(v, pa.int64()) for c, v in zip(("start", "length", "ids_crc32"), cols[2:5], strict=True)}
                yield pa.RecordBatch.from_pydict(data | ({"ids": pa.array(list(cols[5]), pa.list_(pa.int32()))} if with_ids else {}))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(id_key(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, *, size: int = 1024, depth: int = 3, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset.

    A group of equal lengths, however large, is ranked in buckets of about ``PIECES_A_BUCKET`` pieces whose counts
    are then added up; the plan that is joined by broadcast has a few rows per length, so ``size`` bounds it. NULL
    text is empty and gives a piece of the end id alone (none without an end id); a NULL doc_id stays NULL; rows
    that repeat a doc_id each get their pieces; an empty table gives no rows."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, tokenizer_path, size=size, id_col=id_col, text_col=text_col, end_id=end_id, with_ids=with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    rows = slots(plan(histogram, size, depth))
    table = spark.createDataFrame(rows, "length long, first long, last long, sequence long, offset long")
    buckets = max(16, sum(histogram.values()) // PIECES_A_BUCKET)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(within)).join(base, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("nth") - 1).drop("base", "nth", "bucket")
    p, t = ranked.alias("p"), F.broadcast(table).alias("t")
    on = (F.col("p.length") == F.col("t.length")) & F.col("p.rank").between(F.col("t.first"), F.col("t.last"))
    ids = ["p.ids"] if with_ids else []
    return p.join(t, on).select(id_back("p.doc_id").alias("doc_id"), "p.piece", "p.start", "p.length", "p.ids_crc32", *ids, (F.col("t.sequence") + F.col("p.rank") - F.col("t.first")).alias("sequence_id"), "t.offset")
