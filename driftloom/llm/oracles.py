"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .license_scan import LOWER, UPPER, oracle
from .lm import PRIOR

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
LOW_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+')"

SQL = {
    "op1_lm_scoring": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AS tgt FROM documents),
t AS (SELECT doc_id, tgt, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
b AS (SELECT doc_id, tgt, word, coalesce(lag(word) OVER (PARTITION BY doc_id ORDER BY pos), '') AS prev FROM t),
c AS (SELECT prev, word, count(*) AS na, count(*) FILTER (WHERE tgt) AS nt FROM b GROUP BY ALL),
u AS (SELECT word, count(*) AS ua, count(*) FILTER (WHERE tgt) AS ut FROM t GROUP BY word),
r AS (SELECT word AS prev, ua AS ca, ut AS ct FROM u UNION ALL SELECT '', count(*), count(*) FILTER (WHERE tgt) FROM d WHERE len(w) > 0),
n AS (SELECT sum(ua) AS sa, sum(ut) AS st, count(*) AS v FROM u),
p AS (SELECT prev, word, (na + {PRIOR} * ((ua + 1) / (sa + v)::DOUBLE)) / (ca + {PRIOR}) AS pa, (nt + {PRIOR} * ((ut + 1) / (st + v)::DOUBLE)) / (ct + {PRIOR}) AS pt FROM c JOIN r USING (prev) JOIN u USING (word), n),
s AS (SELECT doc_id, count(*) AS n_words, avg(-ln(pt)) AS tl, avg(-ln(pa)) AS bl FROM b JOIN p USING (prev, word) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, round(tl, 4) AS target_loss, round(bl, 4) AS background_loss, round(tl - bl, 4) AS score FROM documents LEFT JOIN s USING (doc_id)""",
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM x),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM g WHERE nth > 1),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.pos) AS kept, count(*) AS n FROM t ANTI JOIN c ON t.doc_id = c.doc_id AND t.pos = c.pos GROUP BY t.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op7_ngram_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, {LOW_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id""",
    "op9_license_scan": f"SELECT * REPLACE (round(score, 6) AS score) FROM ({oracle()})",
}
