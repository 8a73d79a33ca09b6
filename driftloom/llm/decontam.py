"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Words become lower case without punctuation; numbers, names (a capital within a sentence) and units after a number
become typed placeholders. Windows of canonical words are hashed and joined with those of the benchmark, so an item
that was copied with other numbers or names still meets its source. Matches on one diagonal (place in the document
less place in the item) are put together, and what stands in the slots is compared: each value of the item has to
stand for one value of the document throughout, as in a question with new parameters. A window of mostly placeholders says
too little once its values are gone, so it is joined on its words as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
#: Words of a window that aren't placeholders, at least, for it to match with other values; with fewer it matches
#: only word for word.
PLAIN = 4
#: Benchmark windows up to which they are broadcast; beyond it both sides are dealt by hash.
BROADCAST_ROWS = 500_000
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
# Units of measure and money.
UNITS = "km|cm|mm|m|mi|ft|in|kg|g|mg|lb|oz|l|ml|s|sec|min|h|hr|hrs|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|meters|metres|miles|feet|inches|pounds|grams|kilograms|liters|litres|dollars|dollar|euros|euro|cents|percent|usd|eur|gbp"


def tokens_of(text: Column) -> Column:
    """Words of a text; the first character of a slot's word tells its type."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[\p{Ll}\p{N},;:)] )(?=\p{Lu}\p{Ll})", NAME)
    x = F.regexp_replace(x, r"(?<![\p{L}\p{N}.,])(?=[0-9])", NUMBER)
    x = F.regexp_replace(x, rf"(?<=[0-9] )(?=(?:{UNITS})(?![\p{{L}}\p{{N}}]))", UNIT)
    x = F.regexp_replace(x, r"(?:[^\p{L}\p{N}\p{M}\x01-\x03.,]|[.,](?![0-9])|(?<![0-9])[.,])+", " ")
    return F.array_remove(F.split(F.lower(x), " "), "")


def _canonical(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t < "\x04", F.substring(t, 1, 1)).otherwise(t))


def _raw(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t < "\x04", F.substring(t, 2, 1 << 30)).otherwise(t))


def _windows(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row per window: keep, tokens, at, key. The key is that of the canonical words or, with fewer than PLAIN plain
    ones, of the words without marks (a first word may be a name in one text and open a sentence in the other)."""
    at = F.col("at")
    w = df.select(*keep, "tokens", _canonical(F.col("tokens")).alias("canon"), _raw(F.col("tokens")).alias("words")).filter(F.size("canon") >= WINDOW)
    w = w.select(*keep, "tokens", "canon", "words", F.explode(F.sequence(F.lit(0), F.size("canon") - WINDOW)).alias("at"))
    # No lambdas from here to the join: they end the generated code, which then holds all windows of a text as rows.
    of = lambda name: [F.get(name, at + j) for j in range(WINDOW)]
    plain = sum(((t >= "\x04").cast("int") for t in of("canon")), F.lit(0))
    key = F.when(plain >= PLAIN, F.xxhash64(*of("canon"))).otherwise(F.xxhash64(F.lit("words"), *of("words")))
    return w.select(*keep, "tokens", "canon", "at", key.alias("key"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_words: int = 13, least_percent: int = 50, with_hash: bool = False) -> DataFrame:
    """Contaminated documents: a row for each row of ``docs`` and item that match: doc_id, item_id, n_matched (words of
    the item in matching windows of one diagonal), n_item, first_word (of the match in the document), n_slots,
    n_changed (slots with another value), verbatim; with ``with_hash`` also text_hash, xxhash64 of the text's bytes.

    A match needs ``least_words`` words or ``least_percent`` of the item, and slots that agree. Windows with fewer than
    PLAIN words that aren't placeholders match word for word only. Items of fewer words
    than a window, NULL or empty texts and an empty table on either side match nothing; NULL ids are reported as NULL;
    repeated rows are each reported; repeated items once by item_id. Of several places of an item in a text, the one
    of most matched words is reported; of equal ones, that of fewest changed slots, then the earliest. Texts are taken
    whole; other columns are left alone."""
    b = benchmark.select(F.col(item_col).alias("item_id"), tokens_of(F.col(item_text_col)).alias("tokens"))
    w = _windows(b, ["item_id"])
    items = w.select("key", "item_id", F.col("at").alias("item_at"), F.size("tokens").alias("n_item"), F.slice("tokens", F.col("at") + 1, WINDOW).alias("item_words"))
    items = items.distinct()
    small = items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = ["text_hash"] * with_hash
    hashed = [F.xxhash64(F.col(text_col).cast("binary")).alias(x) for x in own]
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), *hashed, tokens_of(F.col(text_col)).alias("tokens"))
    # What is shuffled carries the words of its window; what isn't takes them of the text once it has matched.
    words = F.slice("tokens", F.col("at") + 1, WINDOW) if small else F.array(*(F.get("tokens", F.col("at") + j) for j in range(WINDOW)))
    w = _windows(d, ["row", "doc_id", *own])
    hit = w.join(F.broadcast(items), "key").withColumn("doc_words", words) if small else w.select("row", "doc_id", *own, "at", "key", words.alias("doc_words")).join(items, "key")
    slots = F.filter(F.zip_with("item_words", "doc_words", lambda x, y: F.struct(x.alias("item"), y.alias("doc"))), lambda p: p["item"] < "\x04")
    hit = hit.select("row", "doc_id", *own, "item_id", "n_item", "item_at", "at", (F.col("at") - F.col("item_at")).alias("diagonal"), slots.alias("slots"))
    words = F.array_distinct(F.flatten(F.transform(F.collect_set("item_at"), lambda t: F.sequence(t, t + (WINDOW - 1)))))
    by = hit.groupBy("row", "doc_id", *own, "item_id", "n_item", "diagonal").agg(F.size(words).alias("n_matched"), F.min("at").alias("first_word"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    by = by.withColumn("n_slots", F.size(F.array_distinct(F.transform("slots", lambda p: p["item"])))).withColumn("n_changed", F.size(F.filter("slots", lambda p: p["item"] != p["doc"])))
    enough = (F.col("n_matched") >= least_words) | (100 * F.col("n_matched") >= least_percent * F.col("n_item"))
    sound = by.filter(enough & (F.size("slots") == F.col("n_slots")))
    best = sound.groupBy("row", "doc_id", *own, "item_id").agg(F.max(F.struct("n_matched", (-F.col("n_changed")).alias("same"), (-F.col("first_word")).alias("early"), "n_item", "n_slots")).alias("x"))
    x = F.col("x")
    return best.select("doc_id", "item_id", x["n_matched"].cast("long").alias("n_matched"), x["n_item"].cast("long").alias("n_item"), (-x["early"]).cast("long").alias("first_word"), x["n_slots"].cast("long").alias("n_slots"), (-x["same"]).cast("long").alias("n_changed"), (x["same"] == 0).alias("verbatim"), *own)
