"""Columns and filters that turn a raw log into an event log (case_id, activity, ts, event_order, attributes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_log(df: DataFrame, *, case: str, activity: str, timestamp: str, event_order: str, attributes: tuple[str, ...] = (), timestamp_format: str | None = "infer", spaces: bool = True) -> DataFrame:
    """Canonical names; spaces in activities become underscores; timestamps are inferred, parsed by a format, or left
    as they are (None)."""
    missing = [c for c in (case, activity, timestamp, event_order, *attributes) if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    act, ts = F.col(activity).cast("string"), F.col(timestamp)
    if spaces:
        act = F.replace(act, F.lit(" "), F.lit("_"))
    if timestamp_format == "infer":
        ts = ts if dict(df.dtypes)[timestamp].startswith("timestamp") else ts.cast("timestamp_ntz")
    elif timestamp_format is not None:
        ts = F.to_timestamp_ntz(ts, F.lit(timestamp_format))
    return df.select(F.col(case).cast("string").alias("case_id"), act.alias("activity"), ts.alias("ts"), F.col(event_order).cast("long").alias("event_order"), *attributes)


def completed_only(df: DataFrame, drop: tuple[str, ...] = ("Originator", "EventType")) -> DataFrame:
    """Entries that are complete; their timestamp is that of completion."""
    return df.filter(F.col("EventType") == "complete").withColumnRenamed("Timestamp", "Timestamp_Complete").drop(*drop)


def with_aliases(df: DataFrame, source: str, to: str, aliases: dict[str, str] | None, whitespace: str = "_") -> DataFrame:
    """``to``: the alias of the value with its spaces replaced, or else that value."""
    plain = F.replace(F.col(source), F.lit(" "), F.lit(whitespace))
    if not aliases:
        return df.withColumn(to, plain)
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return df.withColumn(to, F.coalesce(F.element_at(table, plain), plain))


def drop_marker(df: DataFrame, activity: str = "activity", marker: str = "DRIFT_PO") -> DataFrame:
    return df.filter(F.col(activity) != marker)


def island_ids(df: DataFrame, value: str, order: str, name: str = "trace_order") -> DataFrame:
    """Gaps and islands: 0 for the first run of equal values in the given order, one more for each later run.

    Whether a value differs from the one before it needs only its neighbour, so runs are found within ranges of the
    order; the last value and the number of runs of each range, one row apiece, are then put together."""
    from ..functions.staging import staged

    dealt = df.repartitionByRange(order).withColumn("__p", F.spark_partition_id())
    w = Window.partitionBy("__p").orderBy(order)
    dealt = staged(dealt.withColumn("__new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)), "islands")
    ends = dealt.groupBy("__p").agg(F.min_by(F.struct(value), order).alias("a"), F.max_by(F.struct(value), order).alias("z"), F.sum("__new").alias("n"))
    line = Window.orderBy("__p")
    ends = ends.withColumn("__joins", F.when(F.col("a").eqNullSafe(F.lag("z").over(line)), 1).otherwise(0))
    before = F.sum(F.col("n") - F.col("__joins")).over(line.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("n") - F.col("__joins"))
    ends = ends.select("__p", before.alias("__before"), "__joins")
    within = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(ends), "__p").withColumn(name, F.col("__before") + within - F.col("__joins") - 1).drop("__p", "__new", "__before", "__joins")


def first_appearance(df: DataFrame, case: str = "case_id", order: str = "event_order") -> DataFrame:
    """Each case and its first event's order: a key that sorts cases by their first appearance."""
    return df.groupBy(case).agg(F.min(order).alias("first_order"))


def perspective_filter(df: DataFrame, perspectives: list[str]) -> DataFrame:
    known = {"control_flow", "time", "resource", "data"}
    if wrong := set(perspectives) - known:
        raise ValueError(f"unknown perspectives: {sorted(wrong)}; known: {sorted(known)}")
    return df.filter(F.col("perspective").isin(perspectives))
