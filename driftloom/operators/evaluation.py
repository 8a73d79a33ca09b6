"""Evaluation of detections and localizations, and the tables of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .windows import WindowSpec


def drift_metrics(detected: list[int], real: list[int], window: int) -> dict:
    """Greedy matching: a detection finds the first unfound truth at most two windows before it."""
    found, delays = [False] * len(real), []
    for d in sorted(detected):
        for k, r in enumerate(sorted(real)):
            if not found[k] and 0 <= d - r <= 2 * window:
                found[k] = True
                delays.append(d - r)
                break
    hits = sum(found)
    precision, recall = (hits / len(detected) if detected else 0.0), (hits / len(real) if real else 0.0)
    return {"Precision": precision, "Recall": recall, "F1": 2 * precision * recall / (precision + recall) if hits else 0.0, "Delay": sum(delays) / len(delays) if delays else float("nan"), "Detected": found}


def margin_metrics(real: list[int], detected: list[int], margin: float) -> dict:
    """Both lists end with the signal's end, which doesn't count. A truth with an unused detection nearer than margin
    is found."""
    truth, found = real[:-1], detected[:-1]
    used, hits = set(), 0
    for t in truth:
        near = sorted((abs(d - t), d) for d in found if d not in used and abs(d - t) < margin)
        if near:
            used.add(near[0][1])
            hits += 1
    if not found or not truth:
        return {"precision": 0.0, "recall": 0.0, "f1": 0.0, "meantime": float("nan")}
    p, r = hits / len(found), hits / len(truth)
    return {"precision": p, "recall": r, "f1": round(2 * p * r / (p + r), 2) if hits else 0.0, "meantime": sum(min(abs(d - t) for t in truth) for d in found) / len(found)}


def drift_metrics_of(df: DataFrame, detected: str, real: str, window: int) -> DataFrame:
    """``drift_metrics`` of each row's two arrays, as columns Precision, Recall, F1, Delay; in SQL, so a table of many
    configurations stays where it is. NULL arrays are empty."""
    none = F.array().cast("array<long>")
    found, truth = (F.array_sort(F.coalesce(F.col(c).cast("array<long>"), none)) for c in (detected, real))
    df = df.withColumn("__d", found).withColumn("__r", truth)
    places = F.when(F.size("__r") > 0, F.sequence(F.lit(0), F.size("__r") - 1)).otherwise(F.array().cast("array<int>"))

    def step(s, d):
        hit = F.get(F.filter(places, lambda k: ~F.array_contains(s["found"], k) & (d - F.get("__r", k)).between(0, 2 * window)), F.lit(0))
        return F.struct(F.when(hit.isNull(), s["found"]).otherwise(F.concat(s["found"], F.array(hit))).alias("found"), (s["delay"] + F.coalesce(d - F.get("__r", hit), F.lit(0))).alias("delay"))

    s = F.aggregate("__d", F.struct(F.array().cast("array<int>").alias("found"), F.lit(0).cast("long").alias("delay")), step)
    df = df.withColumn("__s", s)
    hits, n, m = F.size("__s.found"), F.size("__d"), F.size("__r")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(hits, n), ratio(hits, m)
    return df.withColumn("Precision", p).withColumn("Recall", r).withColumn("F1", ratio(2 * p * r, p + r)).withColumn("Delay", F.when(hits > 0, F.col("__s.delay") / hits)).drop("__d", "__r", "__s")


def margin_metrics_of(df: DataFrame, real: str, detected: str, margin: float) -> DataFrame:
    """``margin_metrics`` of each row's two arrays, as columns precision, recall, f1, meantime (NULL without any)."""
    none = F.array().cast("array<long>")
    inner = lambda c: F.slice(F.coalesce(F.col(c).cast("array<long>"), none), F.lit(1), F.greatest(F.size(F.coalesce(F.col(c), none)) - 1, F.lit(0)))
    df = df.withColumn("__t", inner(real)).withColumn("__f", inner(detected))

    def step(s, t):
        near = F.filter("__f", lambda d: ~F.array_contains(s["used"], d) & (F.abs(d - t) < margin))
        hit = F.array_min(F.transform(near, lambda d: F.struct(F.abs(d - t).alias("far"), d.alias("d"))))["d"]
        return F.struct(F.when(hit.isNull(), s["used"]).otherwise(F.concat(s["used"], F.array(hit))).alias("used"))

    df = df.withColumn("__s", F.aggregate("__t", F.struct(none.alias("used")), step))
    hits, n, m = F.size("__s.used"), F.size("__f"), F.size("__t")
    some = (n > 0) & (m > 0)
    p, r = F.when(some, hits / n).otherwise(0.0), F.when(some, hits / m).otherwise(0.0)
    far = F.aggregate(F.transform("__f", lambda d: F.array_min(F.transform("__t", lambda t: F.abs(d - t)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, F.round(2 * p * r / (p + r), 2)).otherwise(0.0)).withColumn("meantime", F.when(some, far / n)).drop("__t", "__f", "__s")


def list_match(df: DataFrame, predicted: str, expected: str) -> DataFrame:
    """Adds precision, recall and f1 of two array columns as sets, in lower case."""
    low = lambda c: F.array_distinct(F.transform(c, lambda x: F.lower(x)))
    hit, n, m = F.size(F.array_intersect(low(predicted), low(expected))), F.size(low(predicted)), F.size(low(expected))
    p = F.when(n > 0, hit / n).otherwise(0.0)
    r = F.when(m > 0, hit / m).otherwise(0.0)
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def ground_truth_windows(log: DataFrame, cases: list[str], spec: WindowSpec, n: int) -> DataFrame:
    """truth: the first of the windows over n transitions that holds each case's first one (its end included), found by
    arithmetic, and the number of windows. A transition in a gap or after the last window has none."""
    first = log.filter(F.col("case_id").isin(cases)).groupBy("case_id").agg(F.min("transition_id").alias("t"))
    truth = F.greatest(F.lit(0), F.ceil((F.col("t") - spec.size) / F.lit(spec.stride))).cast("long")
    windows = max(0, spec.last(n) + 1) if n >= spec.size else 0
    found = first.withColumn("truth", truth).filter((F.col("truth") < windows) & (F.col("truth") * spec.stride <= F.col("t")))
    return found.select("truth").union(log.sparkSession.range(1).select(F.lit(windows).cast("long").alias("truth")))


def drift_ground_truth(spark: SparkSession, n: int, share: float = 0.1) -> DataFrame:
    """Every tenth of n traces, the first and the end left out."""
    step = int(n * share)
    return spark.range(step, n, step).select(F.col("id").alias("truth")) if step else spark.range(0).select(F.col("id").alias("truth"))


def roc_auc(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the curve by ranks, ties at their mean rank. Ties are counted first, so only distinct scores are
    put in order."""
    g = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2)
    p, q = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    auc = (F.sum(F.col("pos") * F.col("rank")) - p * (p + 1) / 2) / (p * q)
    return g.groupBy(*by).agg(F.when((p > 0) & (q > 0), auc).alias("auc"))


def param_grid(spark: SparkSession, **values) -> DataFrame:
    """Cartesian product of lists of settings."""
    out = spark.range(1).select()
    for name, v in values.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, v))))
    return out


def results_agg(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, std and the values in order, by keys."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.sort_array(F.collect_list(value)).alias("all_values"))


def best_config(df: DataFrame, per: list[str], score: str, *ties: str) -> DataFrame:
    """The row of the best score by ``per``; ties go by the columns given."""
    w = Window.partitionBy(*per).orderBy(F.desc(score), *ties)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def nearest_lookup(queries: DataFrame, table: DataFrame, at: str, index: str, value: str, width: int) -> DataFrame:
    """As-of join to the nearest index within ``width``; of two as near, the smaller; NULL where none is that near. Each
    query meets the entries of its own bucket of ``width`` and of the two next to it."""
    t = table.select(F.col(index).alias("__i"), F.col(value).alias("__v"))
    q = queries.withColumn("__k", F.monotonically_increasing_id())
    near = q.select("__k", F.col(at).alias("__q"), F.explode(F.array(*(F.floor(F.col(at) / width) + d for d in (-1, 0, 1)))).alias("__b")).join(t.withColumn("__b", F.floor(F.col("__i") / width)), "__b")
    best = near.filter(F.abs(F.col("__i") - F.col("__q")) <= width).groupBy("__k").agg(F.min(F.struct(F.abs(F.col("__i") - F.col("__q")).alias("d"), F.col("__i").alias("i"), F.col("__v").alias("v"))).alias("x"))
    out = q.join(best, "__k", "left").drop("__k")
    return out.select(*queries.columns, F.col("x.i").alias(f"nearest_{index}"), F.col("x.v").alias(value))
