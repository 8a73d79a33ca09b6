"""Token totals that are maintained by deltas.

A batch brings signed changes: an insert adds a document's tokens, a delete takes them away, a revision replaces one
count by another (of the same or another source, language or tokenizer version). A batch is summed to its deltas by
source, language and tokenizer version and written under its own id; totals are the sums of the deltas of all
committed batches. Each attempt writes to a folder of its own and commits by renaming a record of it to the batch's
name, which one attempt alone can do: a batch that is committed, or is being written twice at once, counts once, and
what an attempt leaves that never committed is not read. ``compact`` folds committed batches into one record, whose
ids keep them from being applied again.
"""

from __future__ import annotations

import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tokens import encoder

KEY = ("source", "lang", "tokenizer")
CHANGES = "op string, source string, lang string, tokenizer string, n_tokens long, old_source string, old_lang string, old_tokenizer string, old_n_tokens long"
_DELTA = "source string, lang string, tokenizer string, d_docs long, d_tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """Additive deltas of changes (columns of CHANGES; op is insert, delete or revise; a delete gives the old columns,
    an insert the new ones, a revision both). NULL counts are 0, NULL keys are keys of their own, and a row with
    another op raises."""
    op = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("NULL")))))
    new = F.struct("source", "lang", "tokenizer", F.lit(1).alias("d_docs"), F.coalesce("n_tokens", F.lit(0)).alias("d_tokens"))
    old = F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("old_tokenizer").alias("tokenizer"), F.lit(-1).alias("d_docs"), (-F.coalesce("old_n_tokens", F.lit(0))).alias("d_tokens"))
    parts = F.array_compact(F.array(F.when(op != "delete", new), F.when(op != "insert", old)))
    rows = changes.select(F.explode(parts).alias("x")).select("x.*")
    return rows.groupBy(*KEY).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))


class TokenRollup:
    """Totals kept under ``folder``, in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _records(self) -> dict[str, dict]:
        """Committed records by name: the folder of the deltas and the ids of their batches."""
        root = f"{self.folder}/commits"
        if not self._fs.exists(self._path(root)):
            return {}
        names = sorted(n for x in self._fs.listStatus(self._path(root)) if re.match("(batch|fold)-", n := x.getPath().getName()))
        if not names:
            return {}
        rows = self.spark.read.text([f"{root}/{n}" for n in names], wholetext=True).collect()
        return {r["name"]: r for r in (json.loads(x["value"]) for x in rows)}

    def _live(self) -> dict[str, dict]:
        """Records that count: a fold stands for its batches, and for any fold or batch whose ids it has; of folds with
        equal ids, the first by name."""
        found = self._records()
        ids = {n: set(r["ids"]) for n, r in found.items()}
        rank = lambda n: (len(ids[n]), n.startswith("fold-"))
        covered = lambda n: any(m != n and ids[n] <= ids[m] and (rank(m) > rank(n) or rank(m) == rank(n) and m < n) for m in found)
        return {n: r for n, r in found.items() if not covered(n)}

    def committed(self) -> set[str]:
        return {x for r in self._records().values() for x in r["ids"]}

    def _record(self, name: str, folder: str, ids: list[str]) -> bool:
        """Commits a record; False if its name is taken."""
        sc = self.spark.sparkContext
        jvm, at = sc._jvm, f"{self.folder}/commits"
        self._fs.mkdirs(self._path(at))
        fresh, final = self._path(f"{at}/new-{uuid.uuid4().hex}"), self._path(f"{at}/{name}")
        out = self._fs.create(fresh, False)
        out.write(bytearray(json.dumps({"name": name, "folder": folder, "ids": ids}).encode()))
        out.close()
        # This rename fails where the name is taken, unlike that of FileSystem.
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(final), sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception:
            if not self._fs.exists(final):
                raise
            self._fs.delete(fresh, False)
            return False
        return True

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch; False if it is committed already, before (then without any work) or by another writer."""
        if not re.fullmatch(r"[A-Za-z0-9_.]+", batch_id):
            raise ValueError(f"batch ids are letters, digits, _ and .: {batch_id!r}")
        if batch_id in self.committed():
            return False
        attempt = f"attempt-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.folder}/{attempt}")
        # A fold may have taken the place of another writer's record by now.
        if batch_id not in self.committed() and self._record(f"batch-{batch_id}", attempt, [batch_id]):
            return True
        self._fs.delete(self._path(f"{self.folder}/{attempt}"), True)
        return False

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups without a document are left out."""
        paths = [f"{self.folder}/{r['folder']}" for r in self._live().values()]
        rows = self.spark.read.schema(_DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTA)
        sums = rows.groupBy(*KEY).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.filter("n_docs != 0 or n_tokens != 0")

    def compact(self) -> None:
        """Folds all committed batches into one record. Their own records stay, so no writer can commit one of them
        again; an interrupted fold leaves a folder that no record names, and a fold's deltas are those of its ids."""
        found = self._live()
        if len(found) < 2:
            return
        ids = sorted(x for r in found.values() for x in r["ids"])
        if len(set(ids)) < len(ids):
            raise RuntimeError("folds that share some of their batches: keep one of them")
        to = f"attempt-{uuid.uuid4().hex}"
        self.totals().select(*KEY, F.col("n_docs").alias("d_docs"), F.col("n_tokens").alias("d_tokens")).write.parquet(f"{self.folder}/{to}")
        self._record(f"fold-{uuid.uuid4().hex}", to, ids)


def inserts(docs: DataFrame, tokenizers: dict[str, str], *, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """An insert of each document for each tokenizer version (name: path; no path: words between ASCII white space).

    NULL or empty text has 0 tokens and counts as a document; all rows count, repeated or not."""

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            for name, path in tokenizers.items():
                n = [len((x or "").encode().split()) for x in texts] if not path else [len(encoder(path).encode(x)) // 4 for x in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([name] * len(n), pa.string()), pa.array(n, pa.int64())], ["source", "lang", "tokenizer", "n_tokens"])

    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, "source string, lang string, tokenizer string, n_tokens long")
    none = [F.lit(None).cast(t).alias(f"old_{c}") for c, t in (("source", "string"), ("lang", "string"), ("tokenizer", "string"), ("n_tokens", "long"))]
    return out.select(F.lit("insert").alias("op"), *KEY, "n_tokens", *none)
