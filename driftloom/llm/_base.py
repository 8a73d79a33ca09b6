"""Shared helpers: staged tables in the cluster's shared folder, and word splitting."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import shared_folder

#: Stands in for a missing document id inside operators; results show NULL again.
NO_ID = -(2**63)
#: Deletes nothing but these characters between words.
SPACES = b" \t\n\x0b\x0c\r"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: later steps don't run its plan a second time, and
    a lost executor costs no more than the step that it was in."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def id_back(key: str = "doc_id") -> Column:
    return F.nullif(F.col(key), F.lit(NO_ID))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
