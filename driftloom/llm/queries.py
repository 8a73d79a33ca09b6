"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._base import read_table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .lm import lm_scores

    target = read_table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0")
    scored = lm_scores(read_table(spark, sf_dir, "documents"), target)
    return scored.select("doc_id", "n_words", *(F.round(c, 4).alias(c) for c in ("target_loss", "background_loss", "score")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_dedup

    return substring_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_output

    return token_output(read_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import decontaminate

    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(read_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents: counts under an old version of the words, a revision of each to
    the new one, the counts of a second tokenizer, and the deletion and return of each document without words. Each
    batch is sent twice."""
    from pyspark.sql import functions as F

    from ._base import new_folder, stage
    from .rollup import TokenRollup, inserts

    rollup = TokenRollup(spark, new_folder(spark, "rollup"))
    counted = stage(inserts(read_table(spark, sf_dir, "documents"), {"words-1": "", "byte_bpe_50k-1": _tokenizer("byte_bpe_50k.json")}), "counted")
    words, subwords = (counted.filter(f"tokenizer = '{x}'") for x in ("words-1", "byte_bpe_50k-1"))
    as_old = {f"old_{c}": F.col(c) for c in ("source", "lang", "tokenizer", "n_tokens")}
    gone = words.filter("n_tokens = 0")
    batches = {
        "first": words.withColumn("tokenizer", F.lit("words-0")),
        "revised": words.withColumns(as_old | {"op": F.lit("revise"), "old_tokenizer": F.lit("words-0")}),
        "second": subwords,
        "empty": gone.withColumns(as_old | {"op": F.lit("delete")}).unionByName(gone),
    }
    for _ in range(2):
        for name, changes in batches.items():
            rollup.commit(name, changes)
    return rollup.totals()


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .license_scan import license_scan

    return license_scan(read_table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .pii import find_pii

    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return find_pii(read_table(spark, sf_dir, "documents")).withColumn("spans", shown)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
