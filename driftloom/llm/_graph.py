"""Connected components of a table of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import stage

#: Links that a task contracts at once.
AT_ONCE = 500_000


class Union(dict):
    """Disjoint sets; the smallest member is the root."""

    def root(self, x: int) -> int:
        while (up := self.setdefault(x, x)) != x:
            self[x] = x = self[up] if up in self else up
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)
        return a != b


def _contract(links: DataFrame) -> DataFrame:
    """Links (u, v) of the same components, those that a task holds at once as stars around their smallest node."""

    def stars(held):
        up = Union()
        for u, v in held:
            up.join(u, v)
        rows = [(x, r) for x in list(up) if (r := up.root(x)) != x]
        return pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in rows], pa.int64()), "v": pa.array([r for _, r in rows], pa.int64())})

    def run(batches):
        held: list[tuple[int, int]] = []
        for b in batches:
            held += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            if len(held) >= AT_ONCE:
                yield stars(held)
                held = []
        yield stars(held)

    return links.mapInArrow(run, "u long, v long")


def _settled(edges: DataFrame) -> bool:
    """Whether each node leads to one root, and no root leads on."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.sum("in").alias("in")).filter("out > 1 or (out > 0 and in > 0)").isEmpty()


def components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node long, component long): the smallest node reachable from each node of the links (a long, b long).

    Tasks first contract the links they hold, twice, then alternating large-star and small-star rounds, each a minimum
    by node and a join, so no node's neighbours are gathered in one place; every round is staged. The rounds grow with
    the logarithm of the longest path. A link of a node with itself, or one that repeats, changes nothing."""
    first = _contract(links.select("a", "b")).repartition("u")
    edges = stage(_contract(first).distinct(), "cc")
    for _ in range(most_rounds):
        if _settled(edges):
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # Here every link leads from a node to a smaller one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        to = large.join(least, "u")
        small = to.select(F.col("v").alias("u"), F.col("m").alias("v")).union(to.select("u", F.col("m").alias("v")))
        edges = stage(small.filter("u != v").distinct(), "cc")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
