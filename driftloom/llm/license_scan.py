"""License scan by diagonal voting, in DataFrame operations only.

Every place of a document's words gives the hashes of the 3-word and the 2-word gram that start there; a join with
the grams of fixed templates turns each match into a vote for the diagonal "place in the document less place in the
template". Votes are added up by diagonal, neighbouring diagonals of long templates are merged (a word more or less
shifts the rest by one), and a span is verified by how much of its template its matches cover: all of a short one,
three quarters of a long one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
# Fixed phrases, and the label of each.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Common notices of public licenses, as words; several may have one label.
TEMPLATES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work has been dedicated to the public domain": "public-domain",
}
#: Diagonals of templates of at least LONG words merge when they are up to BAND apart.
LONG, BAND = 12, 2
COVER_PERCENT = 75


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), "")


def _gram(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(words, at + j) for j in range(k)))


def _places(spark) -> DataFrame:
    """A row per gram of each template, and one (template -1) that every document meets once."""
    rows = [(t, w.split(), label, base) for base, table in ((True, BASE), (False, TEMPLATES)) for t, (w, label) in enumerate(table.items(), 0 if base else len(BASE))]
    structs = [F.struct(F.lit(t).alias("template"), F.array(*map(F.lit, w)).alias("t_words"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(min(3, len(w))).alias("k")) for t, w, label, base in rows]
    t = spark.range(1).select(F.explode(F.array(*structs)).alias("t")).select("t.*")
    t = t.withColumn("t_at", F.explode(F.sequence(F.lit(0), F.size("t_words") - F.col("k"))))
    gram = F.when(F.col("k") == 2, _gram(F.col("t_words"), F.col("t_at"), 2)).otherwise(_gram(F.col("t_words"), F.col("t_at"), 3))
    t = t.select(gram.alias("gram"), "template", F.size("t_words").alias("t_size"), "label", "base", "k", "t_at", F.slice("t_words", F.col("t_at") + 1, F.col("k")).alias("t_gram"))
    own = spark.range(1).select(_everyone().alias("gram"), F.lit(-1).alias("template"), F.lit(0).alias("t_size"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("k"), F.lit(0).alias("t_at"), F.array().cast("array<string>").alias("t_gram"))
    return t.unionByName(own)


def _everyone() -> Column:
    return F.xxhash64(F.lit(0), F.lit("every document"))


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans (row, doc_id, n_words, template, label, base, start, end, cover) in words, and for each row of
    ``docs`` one with template -1. The templates are fixed, so their grams can always be broadcast."""
    at = F.col("at")
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    d = d.select("*", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("at"))
    w = F.col("words")
    d = d.select("*", F.explode(F.array(F.when(at < 0, _everyone()).otherwise(_gram(w, at, 3)), F.when(at >= 0, _gram(w, at, 2)))).alias("gram"))
    hit = d.join(F.broadcast(_places(docs.sparkSession)), "gram").filter((F.col("k") == 0) | (F.slice("words", at + 1, F.greatest("k", F.lit(0))) == F.col("t_gram")))
    hit = hit.select("row", "doc_id", F.size("words").alias("n_words"), "template", "t_size", "label", "base", "k", "t_at", "at", (at - F.col("t_at")).alias("diagonal"))
    keys = ["row", "doc_id", "n_words", "template", "t_size", "label", "base", "k"]
    votes = hit.repartition("row").groupBy(*keys, "diagonal").agg(F.collect_set("t_at").alias("t_ats"), F.min("at").alias("first"), F.max("at").alias("last"))
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    band = F.when(F.col("t_size") >= LONG, BAND).otherwise(0)
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= band, 0).otherwise(1)
    votes = votes.withColumn("apart", apart).withColumn("band", F.sum("apart").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("t_ats")), lambda t: F.sequence(t, t + F.greatest(F.max("k"), F.lit(1)) - 1))))
    out = votes.groupBy(*keys, "band").agg(covered.alias("covered"), F.min("first").alias("start"), (F.max("last") + F.max("k")).alias("end"))
    cover = F.when(F.col("t_size") > 0, F.size("covered") / F.col("t_size")).otherwise(0.0)
    return out.select("row", "doc_id", "n_words", "template", "label", "base", "start", "end", cover.alias("cover")).filter(F.col("template").eqNullSafe(-1) | (F.col("cover") >= F.when(F.col("base") | (F.col("t_size") < LONG), 1.0).otherwise(COVER_PERCENT / 100)))


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    NULL or empty text has no words and no labels (empty strings, score 0); a NULL or repeated doc_id gives a row of
    its own; an empty table gives no rows. The score is the greatest part of a template that a span covers."""
    base = F.col("base")
    out = spans(docs, id_col=id_col, text_col=text_col).groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle() -> str:
    """DuckDB SQL for license_scan over the view ``documents``."""
    rows = [(t, w, label, str(base).lower()) for base, table in ((True, BASE), (False, TEMPLATES)) for t, (w, label) in enumerate(table.items(), 0 if base else len(BASE))]
    values = ", ".join(f"({t}, string_split('{w}', ' '), '{label}', {base})" for t, w, label, base in rows)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
t(template, t_words, label, base) AS (VALUES {values}),
tp AS (SELECT *, least(3, len(t_words)) AS k, unnest(range(0, len(t_words) - least(3, len(t_words)) + 1)) AS t_at FROM t),
p AS (SELECT r, words, unnest(range(0, len(words))) AS pos FROM d),
g AS (SELECT r, pos, words[pos + 1] AS a, words[pos + 2] AS b, words[pos + 3] AS c FROM p),
hit AS (SELECT g.r, tp.template, len(tp.t_words) AS t_size, tp.label, tp.base, tp.k, tp.t_at, g.pos, g.pos - tp.t_at AS diagonal FROM g JOIN tp
  ON g.a = tp.t_words[tp.t_at + 1] AND g.b = tp.t_words[tp.t_at + 2] AND (tp.k = 2 OR g.c = tp.t_words[tp.t_at + 3])),
dg AS (SELECT DISTINCT r, template, t_size, diagonal FROM hit),
ap AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= CASE WHEN t_size >= {LONG} THEN {BAND} ELSE 0 END THEN 0 ELSE 1 END AS apart FROM dg),
bd AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS band FROM ap),
cv AS (SELECT h.r, h.template, h.label, h.base, h.t_size, b.band, h.pos, unnest(range(h.t_at, h.t_at + h.k)) AS place FROM hit h JOIN bd b USING (r, template, diagonal)),
sp AS (SELECT r, template, label, base, max(t_size) AS t_size, min(pos) AS start, count(DISTINCT place)::DOUBLE / max(t_size) AS cover FROM cv GROUP BY r, template, label, base, band),
ok AS (SELECT * FROM sp WHERE cover >= CASE WHEN base OR t_size < {LONG} THEN 1.0 ELSE {COVER_PERCENT / 100} END)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, count(*) FILTER (WHERE ok.base)::BIGINT AS n_base,
  min(ok.start) FILTER (WHERE ok.base)::BIGINT AS first_word, max(ok.start) FILTER (WHERE ok.base)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT ok.label, ',' ORDER BY ok.label) FILTER (WHERE ok.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT ok.label, ',' ORDER BY ok.label), '') AS labels, coalesce(max(ok.cover), 0)::DOUBLE AS score
FROM d LEFT JOIN ok USING (r) GROUP BY d.r, d.doc_id, d.words"""
