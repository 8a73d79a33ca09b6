"""Event-log sources and sinks: MXML, XES, CSV, parquet, resumable runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import with_dense_id, with_read_order
from ..operators.prepare import completed_only, island_ids, with_aliases

MXML = "_id string, AuditTrailEntry array<struct<WorkflowModelElement: string, EventType: string, Timestamp: string, timestamp: string, Originator: string, Data: struct<Attribute: array<struct<_VALUE: string, _name: string>>>>>"
_TYPED = "array<struct<_key: string, _value: string>>"
_XES_EVENT = f"struct<string: {_TYPED}, date: {_TYPED}, int: {_TYPED}, float: {_TYPED}, boolean: {_TYPED}>"
XES = f"string {_TYPED}, date {_TYPED}, int {_TYPED}, float {_TYPED}, boolean {_TYPED}, event array<{_XES_EVENT}>"


def read_mxml(spark: SparkSession, path: str) -> DataFrame:
    """CaseId, WorkflowModelElement, EventType, Timestamp, Originator, Data (the last attribute's text), event_order: a
    row per entry of each process instance. Gzip by the file's name."""
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        raw = spark.read.format("xml").option("rowTag", "ProcessInstance").schema(MXML).load(path)
        rows = raw.withColumn("__file", F.input_file_name()).withColumn("__start", F.input_file_block_start())
        e = rows.select(F.col("_id").alias("CaseId"), "__file", "__start", F.explode("AuditTrailEntry").alias("e"))
        out = e.select("CaseId", "__file", "__start", F.col("e.WorkflowModelElement").alias("WorkflowModelElement"), F.col("e.EventType").alias("EventType"), F.coalesce(F.col("e.Timestamp"), F.col("e.timestamp")).alias("Timestamp"), F.col("e.Originator").alias("Originator"), F.element_at(F.col("e.Data.Attribute._VALUE"), -1).alias("Data"))
        return with_read_order(out, "event_order", "__file", "__start")
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def prep_mxml(entries: DataFrame, aliases: dict[str, str] | None = None, whitespace: str = "_") -> DataFrame:
    """Entries with a CaseId; Activity is the alias of the element with its spaces replaced."""
    return with_aliases(entries.filter("CaseId is not null"), "WorkflowModelElement", "Activity", aliases, whitespace)


def all_prep(spark: SparkSession, path: str, aliases: dict[str, str] | None = None, whitespace: str = "_") -> DataFrame:
    """Completed entries with Activity and Trace_order (a new one whenever the case id changes)."""
    return island_ids(prep_mxml(completed_only(read_mxml(spark, path)), aliases, whitespace), "CaseId", "event_order", "Trace_order")


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """Traces flattened: trace_attributes (keys with "case:" before them), attributes (both map<string, string>),
    event_order; ``flatten_xes`` gives columns."""
    raw = spark.read.format("xml").option("rowTag", "trace").schema(XES).load(path)
    kinds = ("string", "date", "int", "float", "boolean")

    def entries(get, prefix=""):
        parts = [F.coalesce(F.transform(get(k), lambda a: F.named_struct(F.lit("key"), F.concat(F.lit(prefix), a["_key"]), F.lit("value"), a["_value"])), F.array().cast("array<struct<key: string, value: string>>")) for k in kinds]
        return F.map_from_entries(F.concat(*parts))

    rows = raw.withColumn("__file", F.input_file_name()).withColumn("__n", F.monotonically_increasing_id())
    e = rows.select("__file", "__n", entries(F.col, "case:").alias("trace_attributes"), F.posexplode("event").alias("__k", "e"))
    e = e.withColumn("attributes", entries(lambda k: F.col(f"e.{k}"))).drop("e")
    return with_dense_id(e, "event_order", "__file", "__n", "__k").drop("__file", "__n", "__k")


def flatten_xes(events: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Named attributes as typed columns: {"case:concept:name": "string", "time:timestamp": "timestamp", ...}."""
    get = lambda name: F.element_at("trace_attributes" if name.startswith("case:") else "attributes", name)
    return events.select(*(get(n).cast(t).alias(n) for n, t in columns.items()), "event_order")


def read_csv_log(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=True)


def list_logs(spark: SparkSession, folder: str, pattern: str = "*", must: tuple[str, ...] = (), must_not: tuple[str, ...] = ()) -> DataFrame:
    """path, length of the files below a folder, by a case-insensitive glob and parts of the path."""
    regex = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    out = files.filter(F.regexp_extract("path", "[^/]*$", 0).rlike(f"(?i)^{regex}$"))
    for part in must:
        out = out.filter(F.col("path").contains(part))
    for part in must_not:
        out = out.filter(~F.col("path").contains(part))
    return out


def path_meta(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds log_name, log_size (the trailing number, "k" for thousands), pattern (what is before it) and noise."""
    stem = F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"(?i)(\.mxml|\.xes|\.csv|\.parquet|\.gz)+$", "")
    size = F.regexp_extract(stem, r"(\d+(?:\.\d+)?)k?$", 1)
    number = F.when(size != "", size.cast("double") * F.when(stem.rlike(r"\dk$"), 1000).otherwise(1)).cast("long")
    noise = F.regexp_extract(path, r"(?i)noise[_-]?(\d+)", 1)
    return df.withColumn("log_name", stem).withColumn("log_size", number).withColumn("pattern", F.regexp_replace(stem, r"[_-]?\d+(?:\.\d+)?k?$", "")).withColumn("noise", F.when(noise != "", noise.cast("int")))


def write_runs(df: DataFrame, folder: str, keys: list[str]) -> None:
    """Adds runs to a table partitioned by their parameters."""
    df.write.mode("append").partitionBy(*keys).parquet(folder)


def missing_runs(grid: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Settings of the grid that the folder has no run of."""
    spark = grid.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(folder)
    if not p.getFileSystem(conf).exists(p):
        return grid
    done = spark.read.parquet(folder).select(*(F.col(k).cast(dict(grid.dtypes)[k]) for k in keys)).distinct()
    return grid.join(done, keys, "left_anti")


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").csv(folder, header=True)
