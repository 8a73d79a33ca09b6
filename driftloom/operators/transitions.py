"""The transition log: one row per directly-follows pair, with artificial starts and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import with_dense_id

START, END = "START", "END"


def transitions(events: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Pairs without ids: START before the first event of a case and END after its last are copies of these events in
    all but activity. One window by case and one explode; no union, no self join."""
    w = Window.partitionBy("case_id").orderBy("ts", "event_order")
    own = ["activity", "ts", "event_order", *attributes]
    e = events.select("case_id", *own, F.row_number().over(w).alias("n"), F.lead(F.struct(*own)).over(w).alias("next"))

    def side(kind: str, value):
        return [value(c).alias(f"{c}_{kind}") for c in own]

    def start(c: str):
        return F.lit(START) if c == "activity" else F.col(c)

    def follower(c: str):
        return F.when(F.col("next").isNull(), F.lit(END) if c == "activity" else F.col(c)).otherwise(F.col("next")[c])

    first = F.struct(*side("from", start), *side("to", F.col), F.lit(0).alias("case_order"))
    follow = F.struct(*side("from", F.col), *side("to", follower), F.col("n").alias("case_order"))
    rows = e.select("case_id", F.explode(F.when(F.col("n") == 1, F.array(first, follow)).otherwise(F.array(follow))).alias("t"))
    return rows.select("case_id", "t.*")


def transition_log(events: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    """``transitions`` with transition_id 0, 1, 2, ... by the orders of the two events (a case of n events gives n + 1
    transitions)."""
    return with_dense_id(transitions(events, attributes), "transition_id", "event_order_from", "event_order_to", "case_order")
