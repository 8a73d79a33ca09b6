"""Engine tests: the mini log worked out by hand, kernels against closed forms and brute force, planted drifts."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.functions import clusters, kernels, stats
from driftloom.functions.clustream import CluStream, inverse_erf
from driftloom.functions.process_tree import discover, render, wrap_text
from driftloom.functions.staging import with_dense_id
from driftloom.operators import changes, clustering, detection, evaluation, features, localization, prepare, traces
from driftloom.operators.transitions import transition_log
from driftloom.operators.windows import WindowSpec, in_windows, pane_windows, window_table

EVENTS = [(0, "c1", "A", 0), (1, "c2", "A", 5), (2, "c3", "A", 7), (3, "c1", "B", 10), (4, "c2", "C", 15), (5, "c1", "C", 20)]


@pytest.fixture(scope="module")
def mini(spark):
    rows = [(o, c, a, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)) for o, c, a, m in EVENTS]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["o", "c", "a", "t"]))
    return prepare.event_log(df, case="c", activity="a", timestamp="t", event_order="o")


@pytest.fixture(scope="module")
def mini_log(mini):
    return transition_log(mini).cache()


def test_transition_log_by_hand(mini_log):
    got = [(r.transition_id, r.case_id, r.activity_from, r.activity_to) for r in mini_log.orderBy("transition_id").collect()]
    assert got == [(0, "c1", "START", "A"), (1, "c1", "A", "B"), (2, "c2", "START", "A"), (3, "c2", "A", "C"), (4, "c3", "START", "A"), (5, "c3", "A", "END"), (6, "c1", "B", "C"), (7, "c2", "C", "END"), (8, "c1", "C", "END")]


def test_whole_log_matrix(mini_log):
    spec = WindowSpec(9, overlap=False)
    tm = features.transition_matrix(mini_log, spec, 9, time=True)
    got = {(r.activity_from, r.activity_to): (r.frequency, round(r.percentual, 6), round(r.probability, 6), r.time_avg) for r in tm.collect()}
    third, ninth = round(1 / 3, 6), round(1 / 9, 6)
    assert got == {("START", "A"): (3, third, 1, 0), ("A", "B"): (1, ninth, third, 10), ("A", "C"): (1, ninth, third, 10), ("A", "END"): (1, ninth, third, 0), ("B", "C"): (1, ninth, 1, 10), ("C", "END"): (2, round(2 / 9, 6), 1, 0)}
    alpha = {(r.activity_from, r.activity_to): (r.causality, r.choice, r.parallel, r.loop) for r in features.alpha_relations(tm).collect()}
    assert alpha[("START", "A")] == (1, 0, 0, 0) and alpha[("A", "B")] == (0, 1, 0, 0) and alpha[("B", "C")] == (1, 0, 0, 0)


@pytest.mark.parametrize("mode,expected", [("Fixed", {1: (2, 0.25), 2: (6, 0.75)}), ("Sliding", {1: (2, 0.25), 2: (4, 0.5)})])
def test_changes_by_hand(mini_log, mode, expected):
    tm = features.transition_matrix(mini_log, WindowSpec(4, 2), 9)
    s = {"d": {"process_feature": "frequency", "method": "aggregation", "agg_function": "sum"}, "p": {"process_feature": "frequency", "method": "percentage"}}
    got = {r.window_index: (r.d, r.p) for r in changes.delta_features(changes.against_reference(tm, mode), s).collect()}
    assert got == expected


def test_g_statistic_by_hand(mini_log):
    tm = features.transition_matrix(mini_log, WindowSpec(4, 2), 9)
    t = changes.contingency_statistics(changes.contingency(changes.against_reference(tm), "frequency")).filter("window_index = 1").first()
    assert t.dof == 3 and t.g == pytest.approx(0.18207, abs=1e-4)


def test_windows(spark):
    spec = WindowSpec(100, 50)
    ids = spark.range(1000).withColumnRenamed("id", "transition_id")
    w = in_windows(ids, spec, 1000).groupBy("window_index").agg(F.count("*").alias("n"), F.min("transition_id").alias("a")).collect()
    assert len(w) == 19 and {r.n for r in w} == {100} and all(r.a == 50 * r.window_index for r in w)
    assert window_table(spark, 1000, spec).count() == 19 and window_table(spark, 99, spec).count() == 0
    panes = pane_windows(spark.range(20).withColumnRenamed("id", "pane"), spec, 1000).groupBy("window_index").count().collect()
    assert {r["count"] for r in panes} == {2} and len(panes) == 19
    gap = in_windows(ids, WindowSpec(100, overlap=False, continuous=False, gap=20), 1000).groupBy("window_index").count().collect()
    assert len(gap) == 8 and {r["count"] for r in gap} == {100}
    with pytest.raises(NotImplementedError):
        WindowSpec(10, 5, kind="Adaptive")


def test_dense_ids_and_islands(spark):
    df = spark.createDataFrame([(i * 3, "abca"[i // 4 % 4]) for i in range(64)], "o long, v string")
    assert [r.i for r in with_dense_id(df, "i", "o").orderBy("o").collect()] == list(range(64))
    got = [r.t for r in prepare.island_ids(df, "v", "o", "t").orderBy("o").collect()]
    want, k = [], -1
    vals = ["abca"[i // 4 % 4] for i in range(64)]
    for i, v in enumerate(vals):
        k += i == 0 or v != vals[i - 1]
        want.append(k)
    assert got == want


def test_alpha_on_parallel_and_loops(spark):
    def flags(edges):
        df = spark.createDataFrame([(0, a, b) for a, b in edges], "window_index long, activity_from string, activity_to string")
        return {(r.activity_from, r.activity_to): (r.causality, r.parallel, r.choice, r.loop) for r in features.alpha_relations(df).collect()}

    par = flags([("S", "A"), ("A", "B"), ("A", "C"), ("B", "C"), ("C", "B"), ("B", "D"), ("C", "D"), ("D", "E")])
    assert par[("B", "C")] == (0, 1, 0, 0) and par[("A", "B")][1] == 1 and par[("S", "A")] == (1, 0, 0, 0)
    ring = ["A", "B", "C", "D", "E"]
    for k in (2, 3, 4, 5):
        cyc = [*zip(ring[:k], ring[1:k] + ring[:1], strict=True), (ring[0], "Z")]
        assert flags(cyc)[(ring[k - 1], ring[0])][3] == (1 if k <= 4 else 0)
    assert flags([("A", "A"), ("A", "B")])[("A", "A")][3] == 1


def test_categorical(spark, mini):
    log = transition_log(mini.withColumn("r", F.when(F.col("case_id") == "c3", None).otherwise(F.col("case_id"))), ("r",))
    spec = WindowSpec(9, overlap=False)
    got = {(r.activity_from, r.activity_to): (r.categorical_unique_r, round(r.categorical_entropy_r, 6)) for r in features.categorical(log, spec, 9, "r").collect()}
    assert got[("START", "A")] == (2, 1.0) and ("A", "END") not in got
    wide = features.wide(features.encodings(log, spec, 9, "r"), "r").filter("activity_from = 'START'").first()
    assert wide["categorical_encoding_frequency_r_c1->c1"] == 1


def test_unknown_features_raise(mini_log):
    with pytest.raises(ValueError):
        features.check_features(("avg_time",))
    with pytest.raises(ValueError):
        changes.delta_features(changes.against_reference(features.transition_matrix(mini_log, WindowSpec(4, 2), 9)), {"x": {"process_feature": "frequency", "method": "aggregation", "agg_function": "nope"}})


def test_tails_against_closed_forms():
    for x in (0.1, 1.0, 3.84, 25.0, 80.0):
        assert stats.chi2_sf(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9)
        assert stats.chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-9)
        assert stats.student_sf2(x, 1) == pytest.approx(1 - 2 * math.atan(x) / math.pi, rel=1e-6)
        assert stats.student_sf2(x, 2) == pytest.approx(1 - x / math.sqrt(2 + x * x), rel=1e-6)
    assert stats.chi2_sf(5, 0) == 1 and stats.norm_sf2(1.959963984540054) == pytest.approx(0.05)
    assert stats.fisher_exact(3, 1, 1, 3) == pytest.approx(34 / 70) and stats.fisher_exact(8, 2, 1, 5) == pytest.approx(0.03496503)


def test_segmentation_against_all_partitions():
    rng = np.random.default_rng(1)
    for _ in range(5):
        x = np.concatenate([rng.normal(0, 0.2, 5), rng.normal(3, 0.2, 6)])
        costs, n = kernels.rbf_costs(x), len(x)
        for pen, least in ((0.5, 1), (1.0, 2), (3.0, 3)):
            best = min((sum(costs[a, b] + pen for a, b in itertools.pairwise((0, *cut, n))), (*cut, n)) for k in range(n) for cut in itertools.combinations(range(1, n), k) if all(b - a >= least for a, b in itertools.pairwise((0, *cut, n))))
            got = kernels.segment(costs, pen, least)
            assert sum(costs[a, b] + pen for a, b in itertools.pairwise((0, *got))) == pytest.approx(best[0])
    assert kernels.segment(kernels.rbf_costs(np.zeros(2)), 1, 5) == [] and kernels.pelt(np.full(20, 1.0), pen=1, min_size=2)[-1] == 21


def test_segmentation_in_memory_in_proportion_to_the_signal():
    import tracemalloc

    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.3, 1500) + np.arange(1500) // 60 % 3
    tracemalloc.start()
    got = kernels.pelt(x, pen=1.5, min_size=5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6
    smooth = kernels.rolling(x, 3)[2:]
    assert got == [i + 3 for i in kernels.segment(kernels.rbf_costs(smooth), 1.5, 5)]


def test_penalty_search_in_memory_in_proportion_to_the_signal():
    import tracemalloc

    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.3, 900) + np.arange(900) // 150 % 2 * 2
    tracemalloc.start()
    few, many = kernels.pelt(x, pen=None, min_size=5), kernels.pelt(np.tile(x, 4), pen=None, min_size=5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6
    costs = kernels.rbf_costs(kernels.rolling(x, 3)[2:])
    by_pen = {p: kernels.segment(costs, p, 5) for p in range(15, -1, -1)}
    first = next(p for p in by_pen if p < len(by_pen[p]))
    assert first < 15 and len(few) == len(by_pen[first]) <= 15 and few == [i + 3 for i in by_pen[first]]
    assert many == [3601]


def test_segments_leave_out_no_start_that_could_be_best():
    rng = np.random.default_rng(3)
    for kind in range(24):
        x = rng.normal(size=(90, 1 + kind % 2))
        # Groups nearer to one another than the least distance that the kernel tells apart, and others.
        x = x * 1e-6 + rng.choice([-0.1, 0, 0.1, 3], size=x.shape) if kind % 3 == 0 else x.cumsum(0) if kind % 3 == 1 else x
        d = ((x[:, None] - x[None]) ** 2).sum(-1)[np.triu_indices(len(x), 1)]
        assert kernels.median_square(x) == np.median(d) and kernels.median_square(x[:6]) == np.median([((a - b) ** 2).sum() for a, b in itertools.combinations(x[:6], 2)])
        costs = kernels.rbf_costs(x)
        total = lambda ends, pen: sum(costs[a, b] + pen for a, b in itertools.pairwise((0, *ends)))
        for pen, least in ((0.01, 2), (0.2, 1), (1.5, 5), (4, 3)):
            ends = kernels.segments(x, [pen], least)[0]
            assert total(ends, pen) == pytest.approx(total(kernels.segment(costs, pen, least), pen), abs=1e-9)
            assert min(b - a for a, b in itertools.pairwise((0, *ends))) >= least
    assert kernels.median_square(np.array([[np.inf], [np.inf], [1.0]])) != kernels.median_square(np.array([[np.inf], [np.inf], [1.0]]))


def test_peaks():
    assert kernels.peaks(np.array([0, 2, 0, 3, 3, 0, 1, 0]), distance=None) == [1, 3, 6]
    assert kernels.peaks(np.array([0, 2, 0, 3, 0, 1, 0]), distance=3) == [3]
    assert kernels.peaks(np.array([0, 5, 4, 4.5, 0]), prominence=1) == [1]


def test_tolerance_restarts_after_a_drift():
    band = kernels.Tolerance(3, 3, 0.01)
    got = [band.step(x)[0] for x in [1, 1, 1, 1, 1, 9, 9, 9, 9, 9, 9, 1]]
    assert got == [False] * 5 + [True] + [False] * 5 + [True]
    half = kernels.Tolerance(3, 3, 0.01)
    for x in [1, 1, 1, 1]:
        half.step(x)
    again = kernels.Tolerance(3, 3, 0.01, half.state())
    assert [again.step(x)[0] for x in [1, 9]] == [False, True]


def test_assignment_against_permutations():
    rng = np.random.default_rng(2)
    for n, m in ((2, 3), (3, 3), (7, 7), (4, 8), (8, 5)):
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in kernels.assignment(c))
        small = c if n <= m else c.T
        best = min(sum(small[i, p] for i, p in enumerate(perm)) for perm in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert got == pytest.approx(best)


def test_planted_drift_is_found(spark):
    rows, o = [], 0
    for case in range(200):
        for a in ("A", "B", "C") if case < 100 else ("A", "C", "B", "D"):
            rows.append((o, f"c{case}", a, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=o)))
            o += 1
    from driftloom.plans.drift import DriftPlan

    ev = prepare.event_log(spark.createDataFrame(pd.DataFrame(rows, columns=["o", "c", "a", "t"])), case="c", activity="a", timestamp="t", event_order="o")
    plan = DriftPlan(ev, WindowSpec(60, 20), strategies={"delta_matrix_strategy": {"p": {"process_feature": "frequency", "method": "percentage"}}, "statistic_test_strategy": {"g": {"process_feature": "frequency", "method": "g_test"}}})
    found = {r.feature: r.detection_results for r in plan.run_detection({"p": {"strategy": "time_series", "pen": 1.5}, "g": {"strategy": "threshold", "operator": "le", "value": 0.025}}).collect()}
    truth = 400 // 20
    assert any(abs(i - truth) <= 4 for i in found["p"][:-1]) and any(abs(i - truth) <= 5 for i in found["g"][:-1])
    last = plan.spec.last(plan.n)
    where = plan.localize(0, last)
    names = {tuple(r.transition) for r in where["significant_changes"].collect()}
    assert ("A", "C") in names and ("C", "B") in names
    acts = {r.activity_from for r in where["dfg_changes"].collect() if r.change_type == "new_activities"}
    assert acts == {"D"}
    text = plan.characterize(0, last, {"sources": ["high_level_changes", "detection_tree", "note"], "main_instructions": "Explain.", "note": "x"})
    assert "Explain." in text and "Sequence" in text and "## note\nx" in text


def test_process_trees():
    seq = discover({("A", "B"), ("B", "C")}, {"A"}, {"C"})
    assert render(seq) == "Sequence( 'A', 'B', 'C' )"
    assert render(discover({("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")}, {"A"}, {"D"})) == "Sequence( 'A', Conditional( 'B', 'C' ), 'D' )"
    assert render(discover({("A", "B"), ("A", "C"), ("B", "C"), ("C", "B"), ("B", "D"), ("C", "D")}, {"A"}, {"D"})) == "Sequence( 'A', Parallel( 'B', 'C' ), 'D' )"
    assert render(discover({("A", "B"), ("B", "A")}, {"A"}, {"A"})) == "Loop( 'A', 'B' )"
    assert "tau" in render(discover({("A", "B"), ("B", "C"), ("A", "C")}, {"A"}, {"C"}))
    assert wrap_text("abc_def ghi", 5) == "abc_\ndef\nghi"


def test_traces_and_tfidf(spark):
    ev = spark.createDataFrame([(0, "A", 0), (1, "A", 1), (2, "A", 2), (0, "B", 3), (1, "C", 4), (0, "C", 5)], "trace_order long, activity string, event_order long")
    t = traces.traces_as_tokens(ev)
    assert {r.trace_order: r.tokens for r in t.collect()} == {0: ["A", "B", "C"], 1: ["A", "C"], 2: ["A"]}
    got = {r.term: round(r.value, 5) for r in traces.vectorize(t, "tfidf").filter("trace_order = 0").collect()}
    assert got == {"A": 1.0, "B": 2.09861, "C": 1.40547}
    assert {(r.trace_order, r.term) for r in traces.vectorize(t, "binary", transitions=True).collect()} == {(0, "A B"), (0, "B C"), (1, "A C")}


def test_clustering(spark):
    x = np.array([[0, 0], [0, 1], [10, 10], [10, 11]], float)
    labels, _ = clusters.kmeans(x, 2)
    r = clusters.describe(x, labels)
    assert r["n_clusters"] == 2 and r["k"] == 1 and r["Silhouette"] > 0.9 and r["centroids"] == [[0, 0.5], [10, 10.5]]
    d = clusters.compare(r, r)
    assert d["diff_centroids"] == 0 and d["total_MSE"] == 0
    v = spark.createDataFrame([(i, [float(i % 2), float(i >= 30) * 5]) for i in range(60)], "trace_order long, vector array<double>")
    run = clustering.run_offline(v, 10, 60, k=2).orderBy("i").toPandas()
    assert run["i"].tolist() == [10, 20, 30, 40, 50, 60] and run["diff_centroids"].iloc[3] == pytest.approx(5.0)
    loc = clustering.localize_all(clustering.run_offline(v, 10, 60, k=2), spark.createDataFrame([(40,)], "drift long"), 10, ["a", "b"]).orderBy(F.desc("score")).collect()
    assert loc[0].dimension == "b" and loc[0].score == pytest.approx(25.0)


def test_clustream_events():
    s = CluStream(h=5, m=2, t=2)
    events = [s.insert(p, i) for i, p in enumerate([[0.0, 0], [10.0, 0], [0.1, 0], [0.2, 0], [50.0, 50], [51.0, 50]])]
    assert events[:2] == [None, None] and events[2] == "FITS_EXISTING_MICROCLUSTER" and events[4] in ("MERGED_MICROCLUSTER", "FORGET_OLD_MICROCLUSTER")
    assert s.n.sum() <= 6 and len(s.ids) == 2
    again = CluStream(h=5, m=2, t=2, state=s.state())
    assert again.insert([51.0, 51.0], 7) == s.insert([51.0, 51.0], 7)
    assert math.erf(inverse_erf(0.5)) == pytest.approx(0.5, abs=1e-3)


def test_batch_and_stream_agree(spark, tmp_path):
    from driftloom.streaming.clustream import BRIEF, run_online, run_stream

    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"stream_id": ["a", "b"] * 20, "index": np.arange(40), "vector": rng.normal(size=(40, 3)).tolist()})
    df = spark.createDataFrame(pdf, "stream_id string, index long, vector array<double>")
    batch = run_online(df, h=10, m=4).select(*BRIEF[:4]).toPandas()
    for k in range(2):
        df.filter(f"floor(index / 20) = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = run_stream(stream, h=10, m=4).select(*BRIEF[:4]).writeStream.format("memory").queryName("clu").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("clu").toPandas()
    key = ["stream_id", "index"]
    assert got.sort_values(key).reset_index(drop=True).equals(batch.sort_values(key).reset_index(drop=True))


def test_transition_stream(spark, mini, tmp_path):
    from driftloom.streaming.events import transition_stream

    mini.coalesce(1).write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema(mini.schema).parquet(str(tmp_path / "ev"))
    q = transition_stream(s).writeStream.format("memory").queryName("tr").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.case_id, r.activity_from, r.activity_to) for r in spark.table("tr").collect()}
    assert got == {("c1", "START", "A"), ("c1", "A", "B"), ("c1", "B", "C"), ("c2", "START", "A"), ("c2", "A", "C"), ("c3", "START", "A")}


MXML = """<WorkflowLog><Source/><Process id="p">
<ProcessInstance id="1"><Data/><AuditTrailEntry><WorkflowModelElement>Do it</WorkflowModelElement><EventType>start</EventType><Timestamp>2020-01-01T00:00:00</Timestamp></AuditTrailEntry>
<AuditTrailEntry><Data><Attribute name="x">u</Attribute><Attribute name="y">v</Attribute></Data><WorkflowModelElement>Do it</WorkflowModelElement><EventType>complete</EventType><Timestamp>2020-01-01T00:05:00</Timestamp><Originator>o</Originator></AuditTrailEntry></ProcessInstance>
<ProcessInstance id="2"><Data/><AuditTrailEntry><WorkflowModelElement>B</WorkflowModelElement><EventType>complete</EventType><Timestamp>2020-01-01T00:06:00</Timestamp></AuditTrailEntry></ProcessInstance>
<ProcessInstance id="1"><Data/><AuditTrailEntry><WorkflowModelElement>C</WorkflowModelElement><EventType>complete</EventType><Timestamp>2020-01-01T00:07:00</Timestamp></AuditTrailEntry></ProcessInstance>
</Process></WorkflowLog>"""
XES = """<log><trace><string key="concept:name" value="t1"/><float key="Amount" value="2.5"/>
<event><string key="concept:name" value="A"/><date key="time:timestamp" value="2020-01-01T00:00:00"/></event><event><string key="concept:name" value="B"/></event></trace></log>"""


def test_sources(spark, tmp_path):
    import gzip

    from driftloom.sources import logs

    (tmp_path / "a.mxml").write_text(MXML)
    with gzip.open(tmp_path / "b.mxml.gz", "wt") as f:
        f.write(MXML)
    for name in ("a.mxml", "b.mxml.gz"):
        raw = logs.read_mxml(spark, str(tmp_path / name)).orderBy("event_order").collect()
        assert [(r.CaseId, r.EventType, r.Data) for r in raw] == [("1", "start", None), ("1", "complete", "v"), ("2", "complete", None), ("1", "complete", None)]
    got = logs.all_prep(spark, str(tmp_path / "a.mxml"), {"Do_it": "X"}).orderBy("event_order").collect()
    assert [(r.Activity, r.Trace_order) for r in got] == [("X", 0), ("B", 1), ("C", 2)]
    (tmp_path / "l.xes").write_text(XES)
    x = logs.flatten_xes(logs.read_xes(spark, str(tmp_path / "l.xes")), {"case:concept:name": "string", "case:Amount": "double", "concept:name": "string", "time:timestamp": "timestamp"}).orderBy("event_order").collect()
    assert [(r["case:concept:name"], r["case:Amount"], r["concept:name"]) for r in x] == [("t1", 2.5, "A"), ("t1", 2.5, "B")]
    names = logs.path_meta(logs.list_logs(spark, str(tmp_path), "*.MXML*")).collect()
    assert {r.log_name for r in names} == {"a", "b"}
    meta = logs.path_meta(spark.createDataFrame([("/x/noise10/cb2.5k.mxml",)], "path string")).first()
    assert (meta.log_size, meta.pattern, meta.noise) == (2500, "cb", 10)
    grid = evaluation.param_grid(spark, w=[1, 2], k=[3])
    runs = str(tmp_path / "runs")
    assert logs.missing_runs(grid, runs, ["w", "k"]).count() == 2
    logs.write_runs(grid.filter("w = 1").withColumn("f1", F.lit(0.5)), runs, ["w", "k"])
    assert [r.w for r in logs.missing_runs(grid, runs, ["w", "k"]).collect()] == [2]


def test_metrics():
    m = evaluation.drift_metrics([110, 250, 420], [100, 200, 300], 50)
    assert m["Detected"] == [True, True, False] and m["Delay"] == 30 and m["F1"] == pytest.approx(2 / 3)
    assert evaluation.margin_metrics([10, 20, 100], [11, 50, 100], 4)["precision"] == 0.5
    assert evaluation.drift_metrics([], [1], 5)["F1"] == 0.0


def test_empty_log(spark):
    ev = spark.createDataFrame([], "case_id string, activity string, ts timestamp_ntz, event_order long")
    assert transition_log(ev).count() == 0
    assert localization.compare_dfgs(*(localization.build_dfg(spark.createDataFrame([], "activity_from string, activity_to string, frequency long")),) * 2).count() == 0


def test_detection_of_a_constant_signal(spark):
    s = spark.createDataFrame([("f", i, 0.0) for i in range(12)], "feature string, window_index long, value double")
    assert detection.threshold(s, "ge", 1.0).first().detection_results == [10]
    assert detection.cpd_pelt(s, size=4, step=4, pen=1.0).first().detection_results == [13]


def test_metrics_of_tables_are_those_of_lists(spark):
    import random

    from driftloom.operators import evaluation

    rng = random.Random(3)
    rows = [(k, sorted(rng.sample(range(300), rng.randint(0, 9))), sorted(rng.sample(range(300), rng.randint(0, 9)))) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, d array<long>, r array<long>")
    one = {x.k: x for x in evaluation.drift_metrics_of(df, "d", "r", 25).collect()}
    two = {x.k: x for x in evaluation.margin_metrics_of(df, "r", "d", 30).collect()}
    for k, d, r in rows:
        a, b = evaluation.drift_metrics(d, r, 25), evaluation.margin_metrics(r, d, 30)
        assert all(one[k][c] == pytest.approx(a[c]) for c in ("Precision", "Recall", "F1")) and (one[k].Delay is None) == (a["Delay"] != a["Delay"])
        assert all(two[k][c] == pytest.approx(b[c], abs=0.006) for c in ("precision", "recall", "f1")) and (two[k].meantime is None) == (b["meantime"] != b["meantime"])
    assert evaluation.drift_metrics_of(df.select("k", F.lit(None).cast("array<long>").alias("d"), "r"), "d", "r", 5).filter("F1 = 0").count() == 60


def test_activities_named_like_artificial_ones(spark):
    from driftloom.operators import localization as L

    ref = spark.createDataFrame([("START", "a", 2), ("a", "unknown_error", 2), ("unknown_error", "END", 2)], "activity_from string, activity_to string, frequency long")
    det = spark.createDataFrame([("START", "a", 2), ("a", "b", 2)], "activity_from string, activity_to string, frequency long")
    got = {tuple(r) for r in L.compare_dfgs(L.build_dfg(ref), L.build_dfg(det)).collect()}
    assert ("deleted_activities", "unknown_error", None) in got and ("deleted_transitions", "a", "unknown_error") in got
    assert not any(x in (L.BEFORE, L.AFTER) for r in got for x in r)


def test_squares_of_values_far_from_zero(spark, mini_log):
    from driftloom.operators.features import transition_matrix
    from driftloom.operators.windows import WindowSpec

    rows = [(k, "a", "b", 1e9 + (k % 3), 1e9 + (k % 3)) for k in range(40)]
    t = spark.createDataFrame(rows, "transition_id long, activity_from string, activity_to string, v_from double, v_to double")
    for r in transition_matrix(t, WindowSpec(12, 3), 40, numeric=("v",)).collect():
        x = [k % 3 for k in range(r.window_index * 3, r.window_index * 3 + 12)]
        assert r.numerical_std_v == pytest.approx((sum((y - sum(x) / 12) ** 2 for y in x) / 11) ** 0.5, rel=1e-6)


def _events(spark, folder, users: int, each: int) -> str:
    """A table of events, ``each`` for every user, dealt to users in turn."""
    rows = [(k, (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=k)).to_pydatetime(), k % users, ("click", "view", "error")[k % 3], k / 4) for k in range(users * each)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def _lines(folder: str) -> dict[str, list[str]]:
    from pathlib import Path

    return {p.parent.name: p.read_text().splitlines() for p in Path(folder.removeprefix("file:")).rglob("part-*")}


def test_prep_mxml_writes_a_line_for_each_event(spark, tmp_path):
    from driftloom import queries

    d = _events(spark, tmp_path, 40, 30)
    docs = _lines(queries._mxml(spark, d))
    assert len(docs) == 8 and sum(map(len, docs.values())) == 1200
    assert max(len(x) for lines in docs.values() for x in lines) < 400
    for lines in docs.values():
        text = "".join(lines)
        assert text.startswith("<log><ProcessInstance id='") and text.endswith("</AuditTrailEntry></ProcessInstance></log>") and text.count("<ProcessInstance ") == text.count("</ProcessInstance>") == 5
    got = {tuple(r): n for *r, n in queries.q_prep_mxml(spark, d).groupBy("CaseId", "WorkflowModelElement", "Activity").count().collect()}
    want = {}
    for k in range(1200):
        kind = ("click", "view", "error")[k % 3]
        key = (str(k % 40), f"user {kind}", "Press" if kind == "click" else f"user_{kind}")
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_scan_mxml_of_one_long_case(spark, tmp_path):
    from driftloom import queries

    d = _events(spark, tmp_path, 1, 3000)
    docs = _lines(queries._mxml(spark, d))
    assert [len(lines) for lines in docs.values()] == [3000] and max(len(x) for lines in docs.values() for x in lines) < 400
    got = queries.q_scan_mxml(spark, d).orderBy("nth").collect()
    want = [("0", f"user {('click', 'view', 'error')[k % 3]}", "complete" if k % 3 else "start", f"o{k % 7}", k / 4, k + 1) for k in range(3000)]
    assert [(r.CaseId, r.WorkflowModelElement, r.EventType, r.Originator, r.Data, r.nth) for r in got] == want


def test_mxml_documents_and_event_order_of_many_events(spark, tmp_path, monkeypatch):
    from driftloom import queries
    from driftloom.sources import logs

    monkeypatch.setattr(queries, "EVENTS_A_DOCUMENT", 100)
    d = _events(spark, tmp_path, 40, 50)
    folder = queries._mxml(spark, d)
    docs = _lines(folder)
    assert len(docs) == 20 and {len(lines) for lines in docs.values()} == {100}
    e = logs.read_mxml(spark, folder)
    rows = e.orderBy("event_order").collect()
    assert [r.event_order for r in rows] == list(range(2000))
    assert [r.CaseId for r in rows] == [c for f in sorted(docs, key=lambda f: f"{f}/") for c in (f[5:], str(int(f[5:]) + 20)) for _ in range(50)]
    assert sum(x.CaseId != y.CaseId for x, y in zip(rows, rows[1:])) == 39
    got = {(r.CaseId, r.nth): r.Data for r in queries.q_scan_mxml(spark, d).collect()}
    assert got == {(str(k % 40), k // 40 + 1): k / 4 for k in range(2000)}
