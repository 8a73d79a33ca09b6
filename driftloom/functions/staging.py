"""Tables written to the cluster's shared folder, and dense ids without a single-task sort."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset (one machine), a temporary folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='driftloom-')}")
    return sc._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_read_order(df: DataFrame, name: str, file: str, start: str) -> DataFrame:
    """Ids 0, 1, 2, ... in the order of files and, within a file, of its rows as they are read. A task reads a split, given
    by ``file`` and ``start``, in one go, so a split's rows are numbered from the place of its first; rows are staged
    as they come, and only a row for each split is sorted and joined back by broadcast."""
    held = staged(df.withColumn("__m", F.monotonically_increasing_id()), "read")
    before = F.coalesce(F.sum("n").over(Window.orderBy(file, start).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = held.groupBy(file, start).agg(F.min("__m").alias("__first"), F.count("*").alias("n")).select(file, start, (before - F.col("__first")).alias("__shift"))
    return held.join(F.broadcast(splits), [file, start]).withColumn(name, F.col("__m") + F.col("__shift")).drop(file, start, "__m", "__shift")


def with_dense_id(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Ids 0, 1, 2, ... in the order of the columns: rows are dealt by ranges and numbered within each; the ranges'
    counts, one row for each partition, are added up and joined back by broadcast. The dealt rows are staged, as
    another run of the plan may draw other ranges."""
    dealt = df.repartitionByRange(*(F.col(c) for c in order)).withColumn("__p", F.spark_partition_id())
    dealt = staged(dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order))), "dense")
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("__p").agg(F.count("*").alias("n")).select("__p", before.alias("__before"))
    return dealt.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__before") + F.col("__n") - 1).drop("__p", "__n", "__before")
