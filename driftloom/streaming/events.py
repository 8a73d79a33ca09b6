"""Streams of events: the transition log with the last event of each case as state, tolerance bands over streams of
measures, and time windows (which count windows don't need; an extra)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import Tolerance


def read_chunks(spark: SparkSession, path: str, schema: str, fmt: str = "csv", files_at_once: int = 1, **options) -> DataFrame:
    """A folder as a stream, some files at a time."""
    return spark.readStream.format(fmt).schema(schema).options(**options).option("maxFilesPerTrigger", files_at_once).load(path)


def transition_stream(events: DataFrame) -> DataFrame:
    """(case_id, activity_from, activity_to, ts_from, ts_to, event_order_from, event_order_to): a row as soon as an event
    arrives; START precedes a case's first event, and END is known to no stream. Events of a micro-batch are taken in the
    order of ts and event_order."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    schema = "case_id string, activity_from string, activity_to string, ts_from timestamp_ntz, ts_to timestamp_ntz, event_order_from long, event_order_to long"

    def step(key, batches, state):
        last = json.loads(state.get[0]) if state.exists else None
        pdf, out = pd.concat(list(batches)).sort_values(["ts", "event_order"]), []
        for a, t, o in zip(pdf["activity"], pdf["ts"], pdf["event_order"], strict=True):
            before = last or ["START", str(t), int(o)]
            out.append((key[0], before[0], a, pd.Timestamp(before[1]), t, before[2], int(o)))
            last = [a, str(t), int(o)]
        state.update((json.dumps(last),))
        yield pd.DataFrame(out, columns=["case_id", "activity_from", "activity_to", "ts_from", "ts_to", "event_order_from", "event_order_to"])

    return events.groupBy("case_id").applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def tolerance_stream(signal: DataFrame, *, rolling_window: int = 5, std_tolerance: float = 3, min_tol: float = 0.0025, order: str = "i") -> DataFrame:
    """(feature, i, drift, lower, upper, mean) of a stream of (feature, i, value)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        band = Tolerance(rolling_window, std_tolerance, min_tol, json.loads(state.get[0]) if state.exists else None)
        pdf = pd.concat(list(batches)).sort_values(order)
        rows = [(key[0], int(i), *band.step(float(x))) for i, x in zip(pdf[order], pdf["value"], strict=True)]
        state.update((json.dumps(band.state()),))
        yield pd.DataFrame(rows, columns=["feature", "i", "drift", "lower", "upper", "mean"])

    return signal.groupBy("feature").applyInPandasWithState(step, "feature string, i long, drift boolean, lower double, upper double, mean double", "state string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by time window and activity, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "activity").count()
