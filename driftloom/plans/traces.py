"""Drift detection and localization by trace clustering, as one configured plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import traces as T
from ..operators.clustering import localize_all, run_offline
from ..operators.detection import tolerance_drift, unpivot


def vectors(events: DataFrame, method: str = "frequency", *, transitions: bool = False, trace: str = "trace_order") -> tuple[DataFrame, list[str]]:
    """Dense trace vectors (trace_order, vector) and their vocabulary: activities, or pairs of them; it is collected, as
    a process has few of either."""
    v = T.vectorize(T.traces_as_tokens(events, trace), method, transitions=transitions, trace=trace)
    words = sorted(r[0] for r in v.select("term").distinct().collect())
    return T.dense(v, words, trace).withColumnRenamed(trace, "trace_order"), words


def detect(run: DataFrame, measure: str, **options) -> DataFrame:
    """Indices i at which the measure leaves its tolerance band."""
    return tolerance_drift(unpivot(run, measure, order="i"), **options).filter("drift").select(F.col("i").alias("drift"))


def cluster_plan(events: DataFrame, window: int, *, method: str = "binary", measure: str = "avg_dist_between_centroids", k: int = 3, transitions: bool = False, trace: str = "trace_order", **band) -> dict[str, DataFrame]:
    """run (clusterings by window), drifts, localization (dimension scores at each drift)."""
    v, words = vectors(events, method, transitions=transitions, trace=trace)
    n = v.count()
    run = run_offline(v, window, n, k=k).cache()
    drifts = detect(run, measure, **band)
    return {"run": run, "drifts": drifts, "localization": localize_all(run, drifts, window, words)}
