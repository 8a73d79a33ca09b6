"""Registered queries over the driver's tables, and their SQL.

``events`` is an event log: case user_id, activity event_type, time ts, order event_id, numeric value, and k of props as
an attribute. Count windows of 200 transitions every 50 stand for the sliding ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import changes as C
from .operators import clustering, detection, evaluation, prepare
from .operators import features as P
from .operators import localization as L
from .functions.staging import shared_folder, staged
from .operators import traces as T
from .operators.transitions import transition_log
from .operators.windows import WindowSpec, in_windows, trace_windows, window_table

SIZE, STEP = 200, 50
SPEC = WindowSpec(SIZE, STEP)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.strip()
        return f

    return add


# Common parts of the SQL.
EVENTS = "ev AS (SELECT user_id::VARCHAR AS case_id, replace(event_type, ' ', '_') AS activity, ts, event_id AS o, value, json_extract_string(props, '$.k') AS k FROM events)"
LOG = EVENTS + """,
le AS (SELECT *, row_number() OVER w AS rn, lead(activity) OVER w AS na, lead(ts) OVER w AS nts, lead(o) OVER w AS no, lead(value) OVER w AS nv, lead(k) OVER w AS nk
  FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY ts, o)),
tr AS (SELECT case_id, 'START' AS a, activity AS b, ts AS t1, ts AS t2, o AS o1, o AS o2, value AS v1, value AS v2, k AS k1, k AS k2, 0 AS co FROM le WHERE rn = 1
  UNION ALL SELECT case_id, activity, coalesce(na, 'END'), ts, coalesce(nts, ts), o, coalesce(no, o), value, CASE WHEN na IS NULL THEN value ELSE nv END, k, CASE WHEN na IS NULL THEN k ELSE nk END, rn FROM le),
tl AS (SELECT *, row_number() OVER (ORDER BY o1, o2, co) - 1 AS tid FROM tr),
nn AS (SELECT count(*) AS n FROM tl)"""


def windows_sql(size: int = SIZE, stride: int = STEP) -> str:
    return f"wi AS (SELECT w.i AS window_index, w.i * {stride} AS s, w.i * {stride} + {size} AS e FROM nn, unnest(range(0, greatest(0, CAST(floor((nn.n - {size}) / {stride}.0) AS BIGINT) + 1))) AS w(i)), tw AS (SELECT wi.window_index, tl.* FROM tl JOIN wi ON tl.tid >= wi.s AND tl.tid < wi.e)"


TM = (
    LOG
    + ", "
    + windows_sql()
    + """,
fr AS (SELECT window_index, a, b, count(*) AS frequency FROM tw GROUP BY ALL),
tm AS (SELECT *, frequency / sum(frequency) OVER (PARTITION BY window_index) AS percentual, frequency / sum(frequency) OVER (PARTITION BY window_index, a) AS probability FROM fr)"""
)


def both_sql(mode: str = "Fixed") -> str:
    """Reference and detection values of frequency and probability."""
    ref = "SELECT d.window_index, r.a, r.b, r.frequency AS rf, r.probability AS rp FROM (SELECT DISTINCT window_index FROM tm WHERE window_index > 0) d JOIN tm r ON r.window_index = " + ("0" if mode == "Fixed" else "d.window_index - 1")
    return f"rr AS ({ref}), bo AS (SELECT coalesce(rr.window_index, t.window_index) AS window_index, coalesce(rr.a, t.a) AS a, coalesce(rr.b, t.b) AS b, coalesce(rf, 0) AS rf, coalesce(rp, 0) AS rp, coalesce(t.frequency, 0) AS df, coalesce(t.probability, 0) AS dp FROM rr FULL JOIN (SELECT * FROM tm WHERE window_index > 0) t ON rr.window_index = t.window_index AND rr.a = t.a AND rr.b = t.b)"


BOTH = TM + ", " + both_sql()
CONT = BOTH + """,
ct AS (SELECT window_index, rf + 5 AS r, df + 5 AS d FROM bo WHERE rf <> 0 OR df <> 0),
c2 AS (SELECT *, sum(r) OVER w AS sr, sum(d) OVER w AS sd, count(*) OVER w AS k FROM ct WINDOW w AS (PARTITION BY window_index)),
c3 AS (SELECT window_index, k, sr + sd AS n, (r + d) * sr / (sr + sd)::DOUBLE AS er, (r + d) * sd / (sr + sd)::DOUBLE AS ed, r, d FROM c2),
c4 AS (SELECT window_index, k, n, er, ed, CASE WHEN k = 2 THEN r + sign(er - r) * least(0.5, abs(er - r)) ELSE r END AS r, CASE WHEN k = 2 THEN d + sign(ed - d) * least(0.5, abs(ed - d)) ELSE d END AS d FROM c3),
st AS (SELECT window_index, max(k) AS k, max(n) AS n, CASE WHEN max(k) > 1 THEN 2 * sum(r * ln(r / er) + d * ln(d / ed)) ELSE 0.0 END AS g, CASE WHEN max(k) > 1 THEN sum((r - er) ** 2 / er + (d - ed) ** 2 / ed) ELSE 0.0 END AS chi2 FROM c4 GROUP BY window_index),
cv AS (SELECT *, CASE WHEN k > 1 THEN sqrt(greatest(0.0, g / n - (k - 1) / (n - 1)::DOUBLE) / least(1 - 1 / (n - 1)::DOUBLE, k - (k - 1) ** 2 / (n - 1)::DOUBLE - 1)) END AS cramers_v FROM st)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))
    return prepare.event_log(raw, case="user_id", activity="event_type", timestamp="ts", event_order="event_id", attributes=("value", "k"))


def log(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    t = transition_log(events(spark, d), ("value", "k"))
    return t, t.count()


def tm(spark: SparkSession, d: str, **options) -> DataFrame:
    t, n = log(spark, d)
    return P.transition_matrix(t, SPEC, n, **options)


def both(spark: SparkSession, d: str, mode: str = "Fixed") -> DataFrame:
    return C.against_reference(tm(spark, d).select("window_index", "activity_from", "activity_to", "frequency", "probability"), mode)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the event log against the first: differences, tests and where a threshold says that it changed."""
    from .plans.drift import DriftPlan

    plan = DriftPlan(events(spark, d), SPEC, strategies={
        "delta_matrix_strategy": {"frequency_delta": {"process_feature": "frequency", "method": "aggregation", "agg_function": "sum"}, "frequency_delta_percentage": {"process_feature": "frequency", "method": "percentage"}},
        "statistic_test_strategy": {"frequency_gtest": {"process_feature": "frequency", "method": "g_test"}, "frequency_cramersv": {"process_feature": "frequency", "method": "cramers_v"}},
    })
    return plan.run_change_representation()


# Preparation.


@query(f"WITH {LOG} SELECT case_id, a AS activity_from, b AS activity_to, t1 AS ts_from, t2 AS ts_to, o1 AS event_order_from, o2 AS event_order_to, co::INT AS case_order, tid::BIGINT AS transition_id FROM tl")
def q_transition_log(spark, d):
    t, _ = log(spark, d)
    return t.select("case_id", "activity_from", "activity_to", "ts_from", "ts_to", "event_order_from", "event_order_to", "case_order", F.col("transition_id").cast("long").alias("transition_id"))


@query("WITH o AS (SELECT o_custkey::VARCHAR AS case_id, replace(o_orderpriority, ' ', '_') AS activity, o_orderdate AS ts, o_orderkey AS o FROM orders), l AS (SELECT *, row_number() OVER w AS rn, lead(activity) OVER w AS na FROM o WINDOW w AS (PARTITION BY case_id ORDER BY ts, o)), t AS (SELECT 'START' AS a, activity AS b FROM l WHERE rn = 1 UNION ALL SELECT activity, coalesce(na, 'END') FROM l) SELECT a AS activity_from, b AS activity_to, count(*) AS frequency FROM t GROUP BY ALL")
def q_transitions_of_orders(spark, d):
    from .operators.transitions import transitions

    o = spark.read.parquet(f"{d}/orders.parquet")
    e = prepare.event_log(o, case="o_custkey", activity="o_orderpriority", timestamp="o_orderdate", event_order="o_orderkey", timestamp_format=None)
    return transitions(e).groupBy("activity_from", "activity_to").agg(F.count("*").alias("frequency"))


@query("WITH l AS (SELECT *, row_number() OVER w AS rn, lead(role) OVER w AS na FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), t AS (SELECT conv_id, 'START' AS a, role AS b FROM l WHERE rn = 1 UNION ALL SELECT conv_id, role, coalesce(na, 'END') FROM l) SELECT a AS activity_from, b AS activity_to, count(*) AS frequency, count(DISTINCT conv_id) AS cases FROM t GROUP BY ALL")
def q_transitions_without_time(spark, d):
    from .operators.transitions import transitions

    c = spark.read.parquet(f"{d}/conversations.parquet")
    e = prepare.event_log(c, case="conv_id", activity="role", timestamp="turn", event_order="turn", timestamp_format=None)
    return transitions(e).groupBy("activity_from", "activity_to").agg(F.count("*").alias("frequency"), F.count_distinct("case_id").alias("cases"))


@query("WITH f AS (SELECT event_id, user_id, lag(event_type) OVER (ORDER BY event_id) AS p, event_type FROM events) SELECT event_id, event_type, (sum(CASE WHEN p = event_type THEN 0 ELSE 1 END) OVER (ORDER BY event_id) - 1)::BIGINT AS trace_order FROM f")
def q_cumulative_counting(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    return prepare.island_ids(e, "event_type", "event_id").select("event_id", "event_type", F.col("trace_order").cast("long").alias("trace_order"))


@query("SELECT user_id::VARCHAR AS case_id, min(event_id) AS first_order FROM events GROUP BY user_id")
def q_case_factorize(spark, d):
    return prepare.first_appearance(events(spark, d))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE replace(event_type, ' ', '_') END AS \"Activity\" FROM events WHERE event_type <> 'error'")
def q_aliases_and_marker(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return prepare.with_aliases(prepare.drop_marker(e, "event_type", "error"), "event_type", "Activity", {"click": "C", "view": "V"}).select("event_id", "Activity")


@query("SELECT o_orderkey, o_orderdate AS \"Timestamp_Complete\" FROM orders WHERE o_orderstatus = 'F'")
def q_completed_only(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    o = o.select("o_orderkey", F.col("o_orderdate").alias("Timestamp"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("start").alias("EventType"))
    return prepare.completed_only(o).select("o_orderkey", "Timestamp_Complete")


# Windows.


def _window_query(name: str, spec: WindowSpec):
    def f(spark, d):
        t, n = log(spark, d)
        w = in_windows(t, spec, n).groupBy("window_index").agg(F.count("*").alias("n"), F.min("transition_id").cast("long").alias("first_id"))
        return window_table(spark, n, spec).join(w, "window_index")

    QUERIES[name] = f
    ORACLES[name] = f"WITH {LOG}, {windows_sql(spec.size, spec.stride)} SELECT wi.window_index, any_value(wi.s) AS start, any_value(wi.e) AS \"end\", count(*) AS n, min(tw.tid) AS first_id FROM wi JOIN tw USING (window_index) GROUP BY wi.window_index"


_window_query("window_sliding", SPEC)
_window_query("window_tumbling", WindowSpec(SIZE, overlap=False))
_window_query("window_gap", WindowSpec(SIZE, overlap=False, continuous=False, gap=30))


@query("WITH t AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS i FROM (SELECT DISTINCT user_id FROM events)) SELECT (i // 20 * 20)::BIGINT AS window_start, count(*) AS n FROM t GROUP BY 1")
def q_trace_window(spark, d):
    from .functions.staging import with_dense_id

    t = with_dense_id(spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct(), "trace_order", "user_id")
    return trace_windows(t, 20, 0).groupBy("window_start").agg(F.count("*").alias("n"))


# Features.


@query(f"WITH {TM} SELECT window_index, a AS activity_from, b AS activity_to, frequency, round(percentual, 6) AS percentual, round(probability, 6) AS probability FROM tm")
def q_tm_control_flow(spark, d):
    return tm(spark, d).select("window_index", "activity_from", "activity_to", "frequency", F.round("percentual", 6).alias("percentual"), F.round("probability", 6).alias("probability"))


@query(f"WITH {TM} SELECT window_index, a AS activity_from, b AS activity_to, frequency, round(frequency / sum(frequency) OVER (PARTITION BY window_index, a), 6) AS probability FROM tm WHERE percentual > 0.02")
def q_anomaly_filter(spark, d):
    return tm(spark, d, threshold=0.02).select("window_index", "activity_from", "activity_to", "frequency", F.round("probability", 6).alias("probability"))


@query(f"WITH {TM} SELECT window_index, a AS activity_from, b AS activity_to, round(avg((epoch_us(t2) - epoch_us(t1)) / 6e7), 4) AS time_avg, round(coalesce(stddev_samp((epoch_us(t2) - epoch_us(t1)) / 6e7), 0), 4) AS time_std FROM tw GROUP BY ALL")
def q_tm_time(spark, d):
    return tm(spark, d, time=True).select("window_index", "activity_from", "activity_to", F.round("time_avg", 4).alias("time_avg"), F.round("time_std", 4).alias("time_std"))


@query(f"WITH {TM} SELECT window_index, a AS activity_from, b AS activity_to, round(coalesce(avg((v1 + v2) / 2), 0) + 1e-9, 5) AS numerical_avg_value, round(coalesce(stddev_samp((v1 + v2) / 2), 0) + 1e-9, 5) AS numerical_std_value FROM tw GROUP BY ALL")
def q_tm_numerical(spark, d):
    return tm(spark, d, numeric=("value",)).select("window_index", "activity_from", "activity_to", *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("numerical_avg_value", "numerical_std_value")))


ENC = f"{TM}, en AS (SELECT window_index, a, b, k1 || '->' || k2 AS value_pair, count(*) AS frequency FROM tw WHERE k1 IS NOT NULL AND k2 IS NOT NULL GROUP BY ALL), ep AS (SELECT *, frequency / sum(frequency) OVER (PARTITION BY window_index, a, b) AS p FROM en)"


@query(f"WITH {ENC} SELECT window_index, a AS activity_from, b AS activity_to, count(*) AS categorical_unique_k, round(-sum(p * log2(p)), 6) + 0 AS categorical_entropy_k FROM ep GROUP BY ALL")
def q_tm_categorical(spark, d):
    t, n = log(spark, d)
    return P.categorical(t, SPEC, n, "k").withColumn("categorical_entropy_k", F.round("categorical_entropy_k", 6) + 0)


@query(f"WITH {ENC} SELECT window_index, a AS activity_from, b AS activity_to, value_pair, frequency, round(p, 6) AS probability FROM ep")
def q_tm_encodings(spark, d):
    t, n = log(spark, d)
    return P.encodings(t, SPEC, n, "k").withColumn("probability", F.round("probability", 6))


#: Edges on simple cycles of at most four edges, and self loops.
CYCLES = "e AS (SELECT DISTINCT window_index, a, b FROM tm), pa AS (SELECT window_index, a AS s, b AS t, [a, b] AS p FROM e WHERE a <> b UNION ALL SELECT pa.window_index, s, e.b, list_append(p, e.b) FROM pa JOIN e ON e.window_index = pa.window_index AND e.a = pa.t AND e.a <> e.b WHERE len(p) < 4 AND NOT list_contains(p, e.b)), cy AS (SELECT pa.window_index, pa.s AS a, pa.p[2] AS b FROM pa JOIN e ON e.window_index = pa.window_index AND e.a = pa.t AND e.b = pa.s UNION SELECT window_index, a, b FROM e WHERE a = b)"


@query(f"WITH RECURSIVE {TM}, {CYCLES}, ed AS (SELECT *, count(*) OVER (PARTITION BY window_index, a) AS deg FROM tm), ca AS (SELECT window_index, a, b, deg, CASE WHEN deg = 1 AND a <> b THEN 1 ELSE 0 END AS causality FROM ed), "
       "ba AS (SELECT x.window_index, x.a, x.b FROM ca x JOIN ca y ON x.window_index = y.window_index AND x.a = y.b AND x.b = y.a WHERE x.a <> x.b AND x.causality = 0 AND y.causality = 0 AND EXISTS (SELECT 1 FROM ca p JOIN ca q ON p.window_index = q.window_index AND p.a = q.a WHERE p.window_index = x.window_index AND p.b = x.a AND q.b = x.b)), "
       "tc AS (SELECT DISTINCT window_index, a AS x FROM ba) "
       "SELECT ca.window_index, ca.a AS activity_from, ca.b AS activity_to, ca.causality::INT AS causality, CASE WHEN ca.causality = 0 AND (t1.x IS NOT NULL OR t2.x IS NOT NULL) THEN 1 ELSE 0 END::INT AS parallel, CASE WHEN deg > 1 AND ca.causality = 0 AND ba.a IS NULL THEN 1 ELSE 0 END::INT AS choice, CASE WHEN cc.a IS NOT NULL AND ba.a IS NULL AND NOT (ca.causality = 0 AND (t1.x IS NOT NULL OR t2.x IS NOT NULL)) THEN 1 ELSE 0 END::INT AS loop "
       "FROM ca LEFT JOIN ba ON ca.window_index = ba.window_index AND ca.a = ba.a AND ca.b = ba.b LEFT JOIN tc t1 ON t1.window_index = ca.window_index AND t1.x = ca.a LEFT JOIN tc t2 ON t2.window_index = ca.window_index AND t2.x = ca.b LEFT JOIN (SELECT DISTINCT * FROM cy) cc ON cc.window_index = ca.window_index AND cc.a = ca.a AND cc.b = ca.b")
def q_alpha_relations(spark, d):
    return P.alpha_relations(tm(spark, d)).select("window_index", "activity_from", "activity_to", "causality", "parallel", "choice", "loop")


@query(f"WITH RECURSIVE {TM}, {CYCLES} SELECT window_index, count(*) AS cycle_edges FROM (SELECT DISTINCT * FROM cy) GROUP BY 1")
def q_alpha_cycle_edges(spark, d):
    """Edges on simple cycles of at most four edges: those that aren't parallel are loops."""
    t = tm(spark, d).select("window_index", "activity_from", "activity_to")
    return P.cycle_edges(t).groupBy("window_index").agg(F.count("*").alias("cycle_edges"))


# Changes.


@query(f"WITH {BOTH} SELECT window_index, 0::BIGINT AS reference_window_index, sum(abs(rf - df))::BIGINT AS frequency_delta, round(sum(abs(rp - dp)), 6) AS probability_delta, round(avg(abs(rf - df)), 6) AS frequency_mean, max(abs(rf - df)) AS frequency_max, round(median(abs(rf - df)), 6) AS frequency_median, round(sum(abs(rf - df)) / (sum(rf) + sum(df)), 6) AS frequency_delta_percentage, round(sum(abs(rp - dp) * abs(rf - df)), 6) AS prob_freq_delta_weight, round(sum(abs(rf - df) + abs(rp - dp)), 6) AS multiple FROM bo GROUP BY window_index")
def q_change_fixed(spark, d):
    s = {
        "frequency_delta": {"process_feature": "frequency", "method": "aggregation", "agg_function": "sum"},
        "probability_delta": {"process_feature": "probability", "method": "aggregation", "agg_function": "sum"},
        "frequency_mean": {"process_feature": "frequency", "method": "aggregation", "agg_function": "mean"},
        "frequency_max": {"process_feature": "frequency", "method": "aggregation", "agg_function": "max"},
        "frequency_median": {"process_feature": "frequency", "method": "aggregation", "agg_function": "median"},
        "frequency_delta_percentage": {"process_feature": "frequency", "method": "percentage"},
        "prob_freq_delta_weight": {"process_feature": "probability", "method": "aggregation_weight", "agg_function": "sum", "weight_feature": "frequency"},
        "multiple": {"process_feature": ["frequency", "probability"], "method": "multiple_aggregation", "agg_function": "sum"},
    }
    out = C.delta_features(both(spark, d), s)
    real = ("probability_delta", "frequency_mean", "frequency_median", "frequency_delta_percentage", "prob_freq_delta_weight", "multiple")
    return out.withColumns({c: F.round(c, 6) for c in real} | {"frequency_delta": F.col("frequency_delta").cast("long")})


@query(f"WITH {TM}, {both_sql('Sliding')} SELECT window_index, (window_index - 1)::BIGINT AS reference_window_index, sum(abs(rf - df))::BIGINT AS frequency_delta, round(sum(abs(rf - df)) / (sum(rf) + sum(df)), 6) AS frequency_delta_percentage FROM bo GROUP BY window_index")
def q_change_sliding(spark, d):
    s = {"frequency_delta": {"process_feature": "frequency", "method": "aggregation", "agg_function": "sum"}, "frequency_delta_percentage": {"process_feature": "frequency", "method": "percentage"}}
    return C.delta_features(both(spark, d, "Sliding"), s).withColumn("frequency_delta_percentage", F.round("frequency_delta_percentage", 6)).withColumn("frequency_delta", F.col("frequency_delta").cast("long"))


@query(f"WITH {BOTH} SELECT window_index, a AS activity_from, b AS activity_to, abs(rf - df)::BIGINT AS delta_frequency, round(abs(rp - dp), 6) AS delta_probability FROM bo")
def q_delta_matrix(spark, d):
    return C.delta_matrix(both(spark, d), "frequency", "probability").withColumn("delta_probability", F.round("delta_probability", 6)).withColumn("delta_frequency", F.col("delta_frequency").cast("long"))


@query(f"WITH {CONT} SELECT window_index, round(g, 6) AS g, round(chi2, 6) AS chi2, (k - 1)::BIGINT AS dof, round(cramers_v, 6) AS cramers_v FROM cv")
def q_contingency_statistics(spark, d):
    t = C.contingency_statistics(C.contingency(both(spark, d), "frequency"))
    return t.select("window_index", *(F.round(c, 6).alias(c) for c in ("g", "chi2", "cramers_v")), F.col("dof").cast("long").alias("dof"))


@query()
def q_test_p_values(spark, d):
    s = {"g_test": {"process_feature": "frequency", "method": "g_test"}, "chi2_test": {"process_feature": "frequency", "method": "chi2_test"}, "cramers_v": {"process_feature": "frequency", "method": "cramers_v"}}
    return C.test_features(both(spark, d), s)


@query()
def q_multiple_g_test(spark, d):
    t, n = log(spark, d)
    return C.multiple_g_test(P.encodings(t, SPEC, n, "k"))


# Detection.

_SIGNAL = f"{BOTH}, si AS (SELECT window_index, sum(abs(rf - df)) / (sum(rf) + sum(df)) AS v FROM bo GROUP BY window_index UNION ALL SELECT 0, NULL)"


def signal(spark, d) -> DataFrame:
    t, n = log(spark, d)
    m = P.transition_matrix(t, SPEC, n).select("window_index", "activity_from", "activity_to", "frequency", "probability")
    s = {"delta_matrix_strategy": {"percentage": {"process_feature": "frequency", "method": "percentage"}}}
    return detection.unpivot(C.change_representation(m, window_table(spark, n, SPEC), s), "percentage")


@query(f"WITH {_SIGNAL}, r AS (SELECT window_index, CASE WHEN count(v) OVER w = 3 THEN avg(v) OVER w END AS m FROM si WINDOW w AS (ORDER BY window_index ROWS 2 PRECEDING)) SELECT window_index, round(m, 6) AS smoothed FROM r")
def q_rolling_mean(spark, d):
    from pyspark.sql import Window

    from .operators.windows import rolling_mean

    return signal(spark, d).select("window_index", F.round(rolling_mean("value", 3, Window.partitionBy("feature").orderBy("window_index")), 6).alias("smoothed"))


@query(f"WITH {_SIGNAL}, f AS (SELECT window_index, CASE WHEN v >= 0.1 THEN 1.0 ELSE 0.0 END AS f FROM si), s AS (SELECT window_index, avg(f) OVER w AS m, count(f) OVER w AS c FROM f WINDOW w AS (ORDER BY window_index ROWS 2 PRECEDING)), "
       "h AS (SELECT window_index - 2 AS i, last_value(CASE WHEN m IN (0, 1) THEN m END IGNORE NULLS) OVER (ORDER BY window_index) AS h FROM s WHERE c = 3), l AS (SELECT i, h, lag(h) OVER (ORDER BY i) AS b FROM h) SELECT 'percentage' AS feature, i::BIGINT AS change_index FROM l WHERE h <> b UNION ALL SELECT 'percentage', (max(i) + 1)::BIGINT FROM h")
def q_comparison_operator(spark, d):
    return detection.comparison_operator(signal(spark, d), "ge", 0.1)


@query()
def q_cpd_pelt(spark, d):
    return detection.cpd_pelt(signal(spark, d), size=SIZE, step=STEP, pen=1.5)


@query()
def q_pelt_penalty_search(spark, d):
    return detection.cpd_pelt(signal(spark, d), size=SIZE, step=STEP)


@query()
def q_peak_detection(spark, d):
    return detection.peak_detection(signal(spark, d), window_size=20)


@query()
def q_tolerance_drift(spark, d):
    return detection.tolerance_drift(signal(spark, d).na.fill(0), order="window_index")


# Localization.

MERGED = f"{TM}, la AS (SELECT max(window_index) AS w FROM tm), me AS (SELECT coalesce(r.a, t.a) AS a, coalesce(r.b, t.b) AS b, coalesce(r.frequency, 0)::DOUBLE AS fr, coalesce(t.frequency, 0)::DOUBLE AS fd, coalesce(r.probability, 0) AS pr, coalesce(t.probability, 0) AS pd FROM (SELECT * FROM tm WHERE window_index = 0) r FULL JOIN (SELECT tm.* FROM tm, la WHERE window_index = la.w) t ON r.a = t.a AND r.b = t.b)"


def two_windows(spark, d) -> tuple[DataFrame, DataFrame]:
    t, n = log(spark, d)
    m = P.transition_matrix(t, SPEC, n).select("window_index", "activity_from", "activity_to", "frequency", "probability")
    m = staged(m.filter(F.col("window_index").isin(0, SPEC.last(n))), "windows")
    return m.filter("window_index = 0").drop("window_index"), m.filter(F.col("window_index") == SPEC.last(n)).drop("window_index")


@query(f"WITH {MERGED} SELECT a AS activity_from, b AS activity_to, fr AS frequency_ref, fd AS frequency_det, round(pr, 6) AS probability_ref, round(pd, 6) AS probability_det FROM me")
def q_merge_windows(spark, d):
    m = L.merge_windows(*two_windows(spark, d))
    return m.select("activity_from", "activity_to", "frequency_ref", "frequency_det", F.round("probability_ref", 6).alias("probability_ref"), F.round("probability_det", 6).alias("probability_det"))


@query(f"WITH {MERGED}, lo AS (SELECT a, b, 'frequency' AS feature, fr AS ref, fd AS det, fr, fd FROM me UNION ALL SELECT a, b, 'probability', pr, pd, fr, fd FROM me), "
       "t AS (SELECT *, CASE WHEN bool_and(ref BETWEEN 0 AND 1 AND det BETWEEN 0 AND 1) OVER f THEN 'proportion' WHEN bool_and(ref = floor(ref) AND det = floor(det)) OVER f THEN 'count' ELSE 'mean' END AS test, ref / nullif(sum(ref) OVER f, 0) AS sr, det / nullif(sum(det) OVER f, 0) AS sd, sum(fr) OVER (PARTITION BY feature, a) AS nr, sum(fd) OVER (PARTITION BY feature, a) AS nd FROM lo WINDOW f AS (PARTITION BY feature)) "
       "SELECT a AS activity_from, b AS activity_to, feature, test, CASE WHEN ref > 0 AND det = 0 THEN 'deleted' WHEN ref = 0 AND det > 0 THEN 'new' ELSE 'changed' END AS status, round(coalesce(sr, 0), 6) AS share_ref, round(coalesce(sd, 0), 6) AS share_det, "
       "round(CASE WHEN test = 'proportion' THEN CASE WHEN ref = det THEN 0.0 ELSE ((ref * nr + 5) / (nr + 5) - (det * nd + 5) / (nd + 5)) / sqrt(((ref * nr + 5 + det * nd + 5) / (nr + 5 + nd + 5)) * (1 - (ref * nr + 5 + det * nd + 5) / (nr + 5 + nd + 5)) * (1 / (nr + 5) + 1 / (nd + 5))) END END, 5) AS z, "
       "round(CASE WHEN test = 'proportion' THEN 2 * (asin(sqrt(ref)) - asin(sqrt(det))) END, 5) AS effect FROM t WHERE (ref <> 0 OR det <> 0) AND NOT (test = 'proportion' AND ref <> det AND (ref * nr + 5 + det * nd + 5) / (nr + 5 + nd + 5) >= 1)")
def q_localization_statistics(spark, d):
    t = L.test_statistics(L.test_choice(L.long_features(L.merge_windows(*two_windows(spark, d)), ("frequency", "probability"))))
    return t.select("activity_from", "activity_to", "feature", "test", "status", *(F.round(c, 6).alias(c) for c in ("share_ref", "share_det")), F.round("z", 5).alias("z"), F.round("effect", 5).alias("effect"))


@query()
def q_significant_changes(spark, d):
    return L.significant_changes(*two_windows(spark, d), ("frequency", "probability"))


DFG = f"{MERGED}, e AS (SELECT 'ref' AS side, a, b, fr AS f FROM me WHERE fr > 0 UNION ALL SELECT 'det', a, b, fd FROM me WHERE fd > 0), k AS (SELECT *, CASE WHEN a = 'START' THEN 'start' WHEN b = 'END' THEN 'end' ELSE 'edge' END AS kind FROM e), nd AS (SELECT DISTINCT side, x FROM (SELECT side, a AS x FROM k WHERE kind = 'edge' UNION ALL SELECT side, b FROM k WHERE kind = 'edge')), gr AS (SELECT side, kind, a, b, f::BIGINT AS f FROM k UNION ALL SELECT side, 'edge', 'unknown_previous_activities', x, 1 FROM nd WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.side = nd.side AND k.b = nd.x AND kind <> 'end') UNION ALL SELECT side, 'edge', x, 'unknown_following_activities', 1 FROM nd WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.side = nd.side AND k.a = nd.x AND kind <> 'start'))"


@query(f"WITH {DFG} SELECT side, kind, a AS activity_from, b AS activity_to, f AS frequency FROM gr")
def q_build_dfg(spark, d):
    ref, det = two_windows(spark, d)
    return L.build_dfg(ref).select(F.lit("ref").alias("side"), "*").union(L.build_dfg(det).select(F.lit("det").alias("side"), "*"))


CMP = f"{DFG}, re AS (SELECT DISTINCT side, kind, a, b FROM gr WHERE a NOT IN ('unknown_previous_activities', 'unknown_following_activities') AND b NOT IN ('unknown_previous_activities', 'unknown_following_activities')), ac AS (SELECT DISTINCT side, x FROM (SELECT side, a AS x FROM re WHERE kind = 'edge' UNION ALL SELECT side, b FROM re WHERE kind = 'edge')), di AS (SELECT CASE side WHEN 'det' THEN 'new' ELSE 'deleted' END || '_transitions' AS change_type, a AS activity_from, b AS activity_to FROM re r WHERE NOT EXISTS (SELECT 1 FROM re o WHERE o.side <> r.side AND o.a = r.a AND o.b = r.b) UNION ALL SELECT CASE side WHEN 'det' THEN 'new' ELSE 'deleted' END || '_activities', x, NULL FROM ac r WHERE NOT EXISTS (SELECT 1 FROM ac o WHERE o.side <> r.side AND o.x = r.x))"


def graphs(spark, d):
    ref, det = two_windows(spark, d)
    return L.build_dfg(ref), L.build_dfg(det)


@query(f"WITH {CMP} SELECT * FROM di")
def q_compare_dfgs(spark, d):
    return L.compare_dfgs(*graphs(spark, d))


@query(f"WITH {CMP} SELECT DISTINCT x AS activity FROM (SELECT activity_from AS x FROM di UNION ALL SELECT activity_to FROM di) WHERE x IS NOT NULL")
def q_changed_activities(spark, d):
    return L.changed_activities(L.compare_dfgs(*graphs(spark, d)))


@query(f"WITH {DFG}, m AS (SELECT a, b, max(f) FILTER (WHERE side = 'ref') AS r, max(f) FILTER (WHERE side = 'det') AS t FROM gr GROUP BY a, b) SELECT a AS activity_from, b AS activity_to, coalesce(r, 0)::BIGINT AS ref, coalesce(t, 0)::BIGINT AS det, CASE WHEN r IS NULL THEN 'blue' WHEN t IS NULL THEN 'red' ELSE 'black' END AS colour FROM m")
def q_dfg_render(spark, d):
    return L.dfg_render(*graphs(spark, d)).drop("label")


@query()
def q_high_level_changes(spark, d):
    ref, det = two_windows(spark, d)
    return L.high_level_changes(L.significant_changes(ref, det, ("frequency", "probability")), L.compare_dfgs(L.build_dfg(ref), L.build_dfg(det)))


@query()
def q_process_tree(spark, d):
    from .functions.process_tree import from_dfg

    return spark.createDataFrame([(side, from_dfg(g.collect())) for side, g in zip(("ref", "det"), graphs(spark, d), strict=True)], "side string, tree string")


# Traces.

TOK = "ev AS (SELECT user_id, event_type, event_id FROM events)"


@query("SELECT user_id AS trace_order, string_agg(event_type, ' ' ORDER BY event_id) AS trace FROM events GROUP BY user_id")
def q_traces_as_tokens(spark, d):
    return tokens(spark, d).select("trace_order", F.array_join("tokens", " ").alias("trace"))


def tokens(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("trace_order"), F.col("event_type").alias("activity"), F.col("event_id").alias("event_order"))
    return T.traces_as_tokens(e)


@query("SELECT user_id AS trace_order, string_agg(CASE event_type WHEN 'click' THEN 'Press' ELSE event_type END, ' ' ORDER BY event_id) AS trace FROM events GROUP BY user_id")
def q_reinverse_tokens(spark, d):
    return T.reinverse_tokens(tokens(spark, d), {"click": "Press"}).select("trace_order", F.array_join("tokens", " ").alias("trace"))


@query("SELECT user_id AS trace_order, event_type AS term, count(*)::DOUBLE AS frequency, 1.0::DOUBLE AS \"binary\" FROM events GROUP BY ALL")
def q_vec_frequency(spark, d):
    t = tokens(spark, d)
    return T.vectorize(t, "frequency").withColumnRenamed("value", "frequency").join(T.vectorize(t, "binary").withColumnRenamed("value", "binary"), ["trace_order", "term"])


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), f AS (SELECT event_type, count(*) AS df FROM c GROUP BY 1), m AS (SELECT count(DISTINCT user_id) AS m FROM events) SELECT user_id AS trace_order, event_type AS term, round(n * (ln(m / df) + 1), 6) AS value FROM c JOIN f USING (event_type), m")
def q_vec_tfidf(spark, d):
    return T.vectorize(tokens(spark, d), "tfidf").withColumn("value", F.round("value", 6))


@query("WITH p AS (SELECT user_id, event_type || ' ' || lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS term FROM events) SELECT user_id AS trace_order, term, count(*)::DOUBLE AS value FROM p WHERE term IS NOT NULL GROUP BY ALL")
def q_vec_transitions(spark, d):
    return T.vectorize(tokens(spark, d), "frequency", transitions=True)


def trace_vectors(spark, d) -> tuple[DataFrame, int]:
    from .functions.staging import with_dense_id

    t = with_dense_id(tokens(spark, d), "n", "trace_order")
    v = T.vectorize(t.select(F.col("n").alias("trace_order"), "tokens"), "frequency")
    words = sorted(r[0] for r in v.select("term").distinct().collect())
    return T.dense(v, words).withColumn("vector", F.transform("vector", lambda x: x)), t.count()


@query()
def q_run_offline(spark, d):
    v, n = trace_vectors(spark, d)
    return clustering.run_offline(v, max(5, n // 10), n, k=3)


@query()
def q_cluster_localization(spark, d):
    v, n = trace_vectors(spark, d)
    w = max(5, n // 10)
    run = clustering.run_offline(v, w, n, k=3)
    return clustering.localize_all(run, run.filter(F.col("window_start") > 0).select(F.col("i").alias("drift")), w, sorted(r[0] for r in spark.read.parquet(f"{d}/events.parquet").select("event_type").distinct().collect()))


@query()
def q_clustream(spark, d):
    from .streaming.clustream import BRIEF, run_online

    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = e.select(F.col("label").cast("string").alias("stream_id"), F.col("vec_id").alias("index"), F.col("embedding").cast("array<double>").alias("vector"))
    return run_online(v, h=150, m=30).select(*BRIEF)


# Evaluation.


@query("WITH RECURSIVE n AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT unnest(range(CAST(floor(n * 0.1) AS BIGINT), n, CAST(floor(n * 0.1) AS BIGINT))) AS truth FROM n")
def q_drift_ground_truth(spark, d):
    return evaluation.drift_ground_truth(spark, spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct().count())


@query(f"WITH {LOG}, {windows_sql()}, f AS (SELECT case_id, min(tid) AS t FROM tl WHERE case_id IN ('3', '7', '11') GROUP BY 1) SELECT min(window_index)::BIGINT AS truth FROM f JOIN wi ON s <= t AND t <= e GROUP BY case_id UNION ALL SELECT count(*)::BIGINT FROM wi")
def q_ground_truth_windows(spark, d):
    t, n = log(spark, d)
    return evaluation.ground_truth_windows(t, ["3", "7", "11"], SPEC, n)


@query("WITH s AS (SELECT l_returnflag AS f, l_quantity AS x, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS y FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY f ORDER BY x) + (count(*) OVER (PARTITION BY f, x) - 1) / 2.0 AS k FROM s) SELECT f AS l_returnflag, round((sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY f")
def q_roc_auc(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_quantity", (F.col("l_discount") > 0.05).cast("int").alias("y"))
    return evaluation.roc_auc(li, "l_quantity", "y", ("l_returnflag",)).withColumn("auc", F.round("auc", 6))


@query("WITH t AS (SELECT user_id, list(DISTINCT lower(event_type)) FILTER (WHERE value < 12) AS p, list(DISTINCT lower(event_type)) FILTER (WHERE value > 8) AS e FROM events GROUP BY 1), s AS (SELECT user_id, coalesce(len(list_intersect(p, e)), 0) AS h, coalesce(len(p), 0) AS n, coalesce(len(e), 0) AS m FROM t), r AS (SELECT user_id, CASE WHEN n > 0 THEN h / n ELSE 0.0 END AS p, CASE WHEN m > 0 THEN h / m ELSE 0.0 END AS r FROM s) SELECT user_id, round(p, 6) AS \"precision\", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM r")
def q_list_match(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    t = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") < 12, F.upper("event_type"))).alias("p"), F.collect_set(F.when(F.col("value") > 8, F.col("event_type"))).alias("e"))
    return evaluation.list_match(t, "p", "e").select("user_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("SELECT w.x::INT AS window_size, k.x::INT AS k, m.x AS model FROM (VALUES (100), (200), (400)) w(x), (VALUES (2), (3), (6)) k(x), (VALUES ('kmeans'), ('birch')) m(x)")
def q_param_grid(spark, d):
    return evaluation.param_grid(spark, window_size=[100, 200, 400], k=[2, 3, 6], model=["kmeans", "birch"])


@query("SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, count(*) AS n FROM lineitem GROUP BY ALL")
def q_results_agg(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return evaluation.results_agg(li, ["l_returnflag", "l_linestatus"], "l_extendedprice").select("l_returnflag", "l_linestatus", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.size("all_values").cast("long").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def q_best_config(spark, d):
    return evaluation.best_config(spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END)::DOUBLE AS \"F\", sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END)::DOUBLE AS \"O\" FROM lineitem GROUP BY 1")
def q_pivot_results(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    p = li.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).sum("l_quantity")
    return p.select("l_returnflag", F.col("F").cast("double").alias("F"), F.col("O").cast("double").alias("O"))


@query("WITH q AS (SELECT event_id, event_id AS x FROM events WHERE event_type = 'click'), t AS (SELECT unnest(range(0, (SELECT max(event_id) + 1 FROM events), 37)) AS i), j AS (SELECT event_id, i, row_number() OVER (PARTITION BY event_id ORDER BY abs(i - x), i) AS n FROM q JOIN t ON abs(i - x) <= 37) SELECT event_id, i AS nearest_i, (i * 2)::BIGINT AS v FROM j WHERE n = 1")
def q_nearest_lookup(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'click'").select("event_id")
    most = spark.read.parquet(f"{d}/events.parquet").agg(F.max("event_id")).first()[0]
    t = spark.range(0, most + 1, 37).select(F.col("id").alias("i"), (F.col("id") * 2).alias("v"))
    return evaluation.nearest_lookup(e, t, "event_id", "i", "v", 37)


RUNS = "t AS (SELECT user_id, coalesce(list_sort(list(event_id) FILTER (WHERE event_type = 'click')), []) AS ds, coalesce(list_sort(list(event_id) FILTER (WHERE event_type = 'purchase')), []) AS rs FROM events GROUP BY 1)"


def detections(spark, d) -> DataFrame:
    """Clicks as detections of purchases, by user."""
    e = spark.read.parquet(f"{d}/events.parquet")
    ids = lambda t: F.array_sort(F.collect_list(F.when(F.col("event_type") == t, F.col("event_id"))))
    return e.groupBy("user_id").agg(ids("click").alias("ds"), ids("purchase").alias("rs"))


@query(f"WITH RECURSIVE {RUNS}, r AS (SELECT user_id, ds, rs, 0 AS k, []::BIGINT[] AS found, 0::BIGINT AS delay FROM t UNION ALL SELECT user_id, ds, rs, k + 1, CASE WHEN c IS NULL THEN found ELSE list_append(found, c) END, delay + coalesce(ds[k + 1] - rs[c], 0) FROM (SELECT *, list_filter(range(1, len(rs) + 1), lambda i: NOT list_contains(found, i) AND ds[k + 1] - rs[i] BETWEEN 0 AND 100)[1] AS c FROM r WHERE k < len(ds))), "
       "z AS (SELECT *, len(found) AS h, CASE WHEN len(ds) > 0 THEN len(found) / len(ds) ELSE 0.0 END AS p, CASE WHEN len(rs) > 0 THEN len(found) / len(rs) ELSE 0.0 END AS q FROM r WHERE k = len(ds)) "
       "SELECT user_id, round(p, 6)::DOUBLE AS \"Precision\", round(q, 6)::DOUBLE AS \"Recall\", round(CASE WHEN h > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 6)::DOUBLE AS \"F1\", round(CASE WHEN h > 0 THEN delay / h END, 6)::DOUBLE AS \"Delay\" FROM z")
def q_drift_metrics(spark, d):
    m = evaluation.drift_metrics_of(detections(spark, d), "ds", "rs", 50)
    return m.select("user_id", *(F.round(c, 6).alias(c) for c in ("Precision", "Recall", "F1", "Delay")))


@query(f"WITH RECURSIVE {RUNS}, u AS (SELECT user_id, rs[1:greatest(len(rs) - 1, 0)] AS ts, ds[1:greatest(len(ds) - 1, 0)] AS fs FROM t), r AS (SELECT user_id, ts, fs, 0 AS k, []::BIGINT[] AS used FROM u UNION ALL SELECT user_id, ts, fs, k + 1, CASE WHEN c IS NULL THEN used ELSE list_append(used, c) END FROM (SELECT *, list_sort(list_transform(list_filter(fs, lambda d: NOT list_contains(used, d) AND abs(d - ts[k + 1]) < 40), lambda d: {{'far': abs(d - ts[k + 1]), 'd': d}}))[1].d AS c FROM r WHERE k < len(ts))), "
       "z AS (SELECT *, len(fs) > 0 AND len(ts) > 0 AS ok, CASE WHEN len(fs) > 0 AND len(ts) > 0 THEN len(used) / len(fs) ELSE 0.0 END AS p, CASE WHEN len(fs) > 0 AND len(ts) > 0 THEN len(used) / len(ts) ELSE 0.0 END AS q FROM r WHERE k = len(ts)) "
       "SELECT user_id, round(p, 6)::DOUBLE AS precision, round(q, 6)::DOUBLE AS recall, CASE WHEN p + q > 0 THEN round(2 * p * q / (p + q), 2) ELSE 0.0 END::DOUBLE AS f1, round(CASE WHEN ok THEN list_sum(list_transform(fs, lambda d: list_min(list_transform(ts, lambda t: abs(d - t))))) / len(fs) END, 6)::DOUBLE AS meantime FROM z")
def q_margin_metrics(spark, d):
    m = evaluation.margin_metrics_of(detections(spark, d), "rs", "ds", 40)
    return m.select("user_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "meantime")))


# Sources: logs written to the shared folder and read back.


def _folder(spark, name: str) -> str:
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Events of a document, about; cases stay whole.
EVENTS_A_DOCUMENT = 50_000


def _written(spark, d, entry, opening, closing: str, name: str) -> str:
    """A folder of documents, eight or as many as the events ask for, with one element for each user, their events in
    order within it, a line for each event: its entry, with the tags that open or close its user's element and the
    document where it is at an end."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{d}/events.parquet").filter("user_id is not null")
    files = max(8, -(-e.count() // EVENTS_A_DOCUMENT))
    e = e.select((F.col("user_id") % files).alias("file"), "user_id", "event_id", entry.alias("entry"), opening(F.col("user_id").cast("string")).alias("opening"))
    w = Window.partitionBy("file").orderBy("user_id", "event_id", "entry")
    e = e.withColumn("before", F.lag("user_id").over(w)).withColumn("after", F.lead("user_id").over(w))
    tag = lambda at, text: F.when(at, text).otherwise("")
    user, last = F.col("user_id"), F.col("after").isNull()
    line = F.concat(
        tag(F.col("before").isNull(), F.lit("<log>")), tag(~user.eqNullSafe(F.col("before")), F.col("opening")),
        F.coalesce("entry", F.lit("")),
        tag(~user.eqNullSafe(F.col("after")), F.lit(closing)), tag(last, F.lit("</log>")),
    )
    folder = _folder(spark, name)
    # The window leaves the rows sorted by file first, so the writer keeps their order.
    e.select("file", line.alias("value")).write.partitionBy("file").text(folder)
    return folder


def _mxml(spark, d) -> str:
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    kind = F.when(F.col("event_id") % 3 == 0, "start").otherwise("complete")
    entry = F.concat(F.lit("<AuditTrailEntry><Data><Attribute name='x'>a</Attribute><Attribute name='v'>"), F.col("value").cast("string"), F.lit("</Attribute></Data><WorkflowModelElement>user "), F.col("event_type"), F.lit("</WorkflowModelElement><EventType>"), kind, F.lit("</EventType><Timestamp>"), stamp, F.lit("</Timestamp><Originator>o"), (F.col("event_id") % 7).cast("string"), F.lit("</Originator></AuditTrailEntry>"))
    return _written(spark, d, entry, lambda user: F.concat(F.lit("<ProcessInstance id='"), user, F.lit("'>")), "</ProcessInstance>", "mxml")


MX = "mx AS (SELECT user_id::VARCHAR AS \"CaseId\", 'user ' || event_type AS el, CASE WHEN event_id % 3 = 0 THEN 'start' ELSE 'complete' END AS ty, strftime(ts, '%Y-%m-%d %H:%M:%S') AS st, 'o' || (event_id % 7) AS orig, value, event_id FROM events)"


@query(f"WITH {MX} SELECT \"CaseId\", el AS \"WorkflowModelElement\", ty AS \"EventType\", st AS \"Timestamp\", orig AS \"Originator\", value::DOUBLE AS \"Data\", row_number() OVER (PARTITION BY \"CaseId\" ORDER BY event_id) AS nth FROM mx")
def q_scan_mxml(spark, d):
    from pyspark.sql import Window

    from .sources.logs import read_mxml

    e = read_mxml(spark, _mxml(spark, d))
    return e.withColumn("nth", F.row_number().over(Window.partitionBy("CaseId").orderBy("event_order")).cast("long")).withColumn("Data", F.col("Data").cast("double")).drop("event_order")


@query(f"WITH {MX} SELECT \"CaseId\", el AS \"WorkflowModelElement\", CASE el WHEN 'user click' THEN 'Press' ELSE replace(el, ' ', '_') END AS \"Activity\" FROM mx")
def q_prep_mxml(spark, d):
    from .sources.logs import prep_mxml, read_mxml

    return prep_mxml(read_mxml(spark, _mxml(spark, d)), {"user_click": "Press"}).select("CaseId", "WorkflowModelElement", "Activity")


@query(f"WITH {MX} SELECT \"CaseId\", replace(el, ' ', '_') AS \"Activity\", st AS \"Timestamp_Complete\", 1::BIGINT AS traces FROM mx WHERE ty = 'complete'")
def q_all_prep(spark, d):
    """Completed entries; each case is one trace here, as its entries stand together."""
    from pyspark.sql import Window

    from .sources.logs import all_prep

    e = all_prep(spark, _mxml(spark, d))
    own = Window.partitionBy("CaseId")
    return e.withColumn("traces", (F.max("Trace_order").over(own) - F.min("Trace_order").over(own) + 1).cast("long")).select("CaseId", "Activity", "Timestamp_Complete", "traces")


@query("SELECT user_id::VARCHAR AS case_name, event_type AS activity, ts, value, (event_id % 7)::BIGINT AS part, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events")
def q_scan_xes(spark, d):
    from pyspark.sql import Window

    from .sources.logs import flatten_xes, read_xes

    pair = lambda kind, key, value: F.concat(F.lit(f"<{kind} key='{key}' value='"), value, F.lit("'/>"))
    entry = F.concat(F.lit("<event>"), pair("string", "concept:name", F.col("event_type")), pair("date", "time:timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")), pair("float", "value", F.col("value").cast("string")), pair("int", "part", (F.col("event_id") % 7).cast("string")), F.lit("</event>"))
    folder = _written(spark, d, entry, lambda user: F.concat(F.lit("<trace>"), pair("string", "concept:name", user)), "</trace>", "xes")
    e = flatten_xes(read_xes(spark, folder), {"case:concept:name": "string", "concept:name": "string", "time:timestamp": "timestamp_ntz", "value": "double", "part": "long"})
    e = e.toDF("case_name", "activity", "ts", "value", "part", "event_order")
    return e.withColumn("nth", F.row_number().over(Window.partitionBy("case_name").orderBy("event_order")).cast("long")).drop("event_order")


@query("SELECT event_id, user_id, event_type, value FROM events")
def q_scan_csv(spark, d):
    from .sources.logs import read_csv_log, write_csv

    folder = _folder(spark, "csv")
    write_csv(spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value"), folder)
    return read_csv_log(spark, folder, "event_id long, user_id long, event_type string, value double")


@query("SELECT c_custkey, 'cp_' || c_custkey || 'k' AS log_name, c_custkey * 1000 AS log_size, 'cp' AS pattern, (c_custkey % 30)::INT AS noise FROM customer")
def q_parse_path_meta(spark, d):
    from .sources.logs import path_meta

    c = spark.read.parquet(f"{d}/customer.parquet")
    name = F.concat(F.lit("/logs/noise_"), F.col("c_custkey") % 30, F.lit("/cp_"), F.col("c_custkey"), F.lit("k.mxml.gz"))
    return path_meta(c.select("c_custkey", name.alias("path"))).drop("path")


# Further branches.


@query("WITH t AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i FROM (SELECT DISTINCT user_id FROM events)), n AS (SELECT count(*) AS n FROM t), w AS (SELECT unnest(range(0, greatest(0, n - 20 + 1), 5)) AS s FROM n) SELECT s::BIGINT AS window_start, count(*) AS n, sum(user_id)::BIGINT AS users FROM w JOIN t ON i >= s AND i < s + 20 GROUP BY s")
def q_trace_window_sliding(spark, d):
    from .functions.staging import with_dense_id

    t = with_dense_id(spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct(), "trace_order", "user_id")
    return trace_windows(t, 20, t.count(), sliding=True, step=5).groupBy("window_start").agg(F.count("*").alias("n"), F.sum("user_id").cast("long").alias("users"))


@query(f"WITH {TM}, k AS (SELECT * FROM tm WHERE frequency > 4) SELECT window_index, a AS activity_from, b AS activity_to, frequency, round(frequency / sum(frequency) OVER (PARTITION BY window_index, a), 6) AS probability FROM k")
def q_anomaly_filter_count(spark, d):
    return tm(spark, d, threshold=4).select("window_index", "activity_from", "activity_to", "frequency", F.round("probability", 6).alias("probability"))


BIGRAMS = "p AS (SELECT user_id, event_type || ' ' || lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS term FROM events), c AS (SELECT user_id, term, count(*) AS n FROM p WHERE term IS NOT NULL GROUP BY ALL)"


@query(f"WITH {BIGRAMS} SELECT user_id AS trace_order, term, 1.0::DOUBLE AS value FROM c")
def q_vec_binary_transitions(spark, d):
    return T.vectorize(tokens(spark, d), "binary", transitions=True)


@query(f"WITH {BIGRAMS}, f AS (SELECT term, count(*) AS df FROM c GROUP BY 1), m AS (SELECT count(DISTINCT user_id) AS m FROM events) SELECT user_id AS trace_order, c.term, round(n * (ln(m / df) + 1), 6) AS value FROM c JOIN f USING (term), m")
def q_vec_tfidf_transitions(spark, d):
    return T.vectorize(tokens(spark, d), "tfidf", transitions=True).withColumn("value", F.round("value", 6))


@query(f"WITH {ENC}, ct AS (SELECT window_index, a, b, count(*) AS u, -sum(p * log2(p)) AS h FROM ep GROUP BY ALL), ti AS (SELECT window_index, a, b, avg((epoch_us(t2) - epoch_us(t1)) / 6e7) AS m FROM tw GROUP BY ALL) SELECT tm.window_index, tm.a AS activity_from, tm.b AS activity_to, tm.frequency, round(ti.m, 4) AS time_avg, coalesce(u, 0) AS categorical_unique_k, round(coalesce(h, 0), 6) + 0 AS categorical_entropy_k FROM tm JOIN ti USING (window_index, a, b) LEFT JOIN ct USING (window_index, a, b)")
def q_tm_merge(spark, d):
    t, n = log(spark, d)
    m = P.full_matrix(t, SPEC, n, time=True, categorical_attrs=("k",))
    return m.select("window_index", "activity_from", "activity_to", "frequency", F.round("time_avg", 4).alias("time_avg"), "categorical_unique_k", (F.round("categorical_entropy_k", 6) + 0).alias("categorical_entropy_k"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


