"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and returns a
DataFrame; all but the last return the columns of ``documents``. Verdicts go with the row or are joined by id and hash
of the text, so rows that share an id, or have none, each get their own; rows equal in both are one document, of which
the stage of near duplicates keeps one. NULL and empty texts fail the quality rules; texts of any length are taken
whole; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm._base import id_key, read_table, stage
from driftloom.llm.decontam import decontaminate
from driftloom.llm.jaccard import jaccard_join
from driftloom.llm.packing import pack
from driftloom.llm.pii import redact
from driftloom.llm.quality import keep_good


def _by_row(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` that are (left_semi) or aren't (left_anti) among ``rows`` (doc_id, text_hash), once each; by
    merge at every size, as the rows grow with the documents."""
    key, text = "row_id", "row_text"
    while {key, text} & set(docs.columns):
        key, text = key + "_", text + "_"
    wanted = rows.select(id_key("doc_id").alias(key), F.col("text_hash").alias(text)).distinct()
    marked = docs.withColumn(key, id_key("doc_id")).withColumn(text, F.xxhash64(F.col("text").cast("binary")))
    return marked.join(wanted.hint("merge"), [key, text], how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates."""
    kept = _by_row(docs, jaccard_join(docs, with_first=True).filter("first"), "left_semi")
    return kept.dropDuplicates([c for c in kept.columns if c not in docs.columns]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text of the benchmark."""
    found = decontaminate(docs, read_table(spark, sf_dir, "benchmark"), with_hash=True)
    return _by_row(docs, found, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is that of the new text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("best-fit packing", packing),
]
#: SQL expresses neither the estimated models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, f) in enumerate(STAGES, 1):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stage(docs, "pipeline")
    return docs
