"""Count windows over a dense id, by arithmetic instead of a join."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WindowSpec:
    """overlap: starts every ``step``; else tumbling (continuous) or with ``gap`` ids between windows."""

    size: int
    step: int | None = None
    overlap: bool = True
    continuous: bool = True
    gap: int = 0
    kind: str = "Fixed"

    def __post_init__(self):
        if self.kind != "Fixed":
            raise NotImplementedError("only windows of a fixed size")
        if self.size < 1 or (self.overlap and not (self.step or 0) > 0):
            raise ValueError("size and step have to be at least 1")

    @property
    def stride(self) -> int:
        return self.step if self.overlap else self.size + (0 if self.continuous else self.gap)

    def last(self, n):
        """Index of the last whole window of n ids; -1 if there is none."""
        return F.floor((n - F.lit(self.size)) / self.stride) if not isinstance(n, int) else (n - self.size) // self.stride

    def pane(self) -> int:
        """Ids in a pane: every window is a whole number of panes."""
        return math.gcd(self.size, self.stride)


def window_table(spark: SparkSession, n: int, spec: WindowSpec) -> DataFrame:
    """window_index, start, end (half open); windows that would end after n are left out."""
    count = max(0, spec.last(n) + 1) if n >= spec.size else 0
    w = spark.range(count).select(F.col("id").alias("window_index"))
    return w.select("window_index", (F.col("window_index") * spec.stride).alias("start"), (F.col("window_index") * spec.stride + spec.size).alias("end"))


def in_windows(df: DataFrame, spec: WindowSpec, n: int, id_col: str = "transition_id") -> DataFrame:
    """Each row once for each window that holds it."""
    t, lo_bound = F.col(id_col), F.ceil((F.col(id_col) - spec.size + 1) / F.lit(spec.stride))
    lo, hi = F.greatest(F.lit(0), lo_bound).cast("long"), F.least(F.floor(t / F.lit(spec.stride)), F.lit(spec.last(n))).cast("long")
    rows = df.withColumn("__lo", lo).withColumn("__hi", hi).filter("__lo <= __hi")
    if spec.stride >= spec.size:
        return rows.withColumnRenamed("__lo", "window_index").drop("__hi")
    return rows.withColumn("window_index", F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")


def pane_windows(df: DataFrame, spec: WindowSpec, n: int, pane_col: str = "pane") -> DataFrame:
    """Rows of panes, each once for each window that holds the pane."""
    g = spec.pane()
    p = F.col(pane_col) * g
    lo = F.greatest(F.lit(0), F.ceil((p + g - spec.size) / F.lit(spec.stride))).cast("long")
    hi = F.least(F.floor(p / F.lit(spec.stride)), F.lit(spec.last(n))).cast("long")
    return df.withColumn("__lo", lo).withColumn("__hi", hi).filter("__lo <= __hi").withColumn("window_index", F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")


def trace_windows(df: DataFrame, size: int, n: int, *, sliding: bool = False, step: int = 5, id_col: str = "trace_order") -> DataFrame:
    """Windows over traces: tumbling with the last, partial one, or sliding over whole ones; window_start is the first
    trace's number."""
    if not sliding:
        return df.withColumn("window_start", (F.floor(F.col(id_col) / size) * size).cast("long"))
    spec = WindowSpec(size, step)
    return in_windows(df, spec, n, id_col).withColumn("window_start", F.col("window_index") * step).drop("window_index")


def rolling_mean(col: str, k: int, order):
    """Mean of k values; NULL until there are k, and where one of them is NULL. ``order`` is a window spec."""
    w = order.rowsBetween(-(k - 1), 0)
    return F.when(F.count(col).over(w) == k, F.avg(col).over(w))
