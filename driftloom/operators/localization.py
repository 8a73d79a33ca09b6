"""Localization: which transitions and activities differ between two windows, by which feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import CONTROL_FLOW, PAIR
from .transitions import END, START

#: Artificial activities of a graph; any other name is an activity's own.
BEFORE, AFTER = "unknown_previous_activities", "unknown_following_activities"


def perspective_of(feature: str, resource: tuple[str, ...] = (), data: tuple[str, ...] = ()) -> str:
    if feature in CONTROL_FLOW:
        return "control_flow"
    if feature.startswith("time_"):
        return "time"
    for name, attrs in (("resource", resource), ("data", data)):
        if any(feature.endswith(f"_{a}") for a in attrs):
            return name
    return "unknown"


def merge_windows(ref: DataFrame, det: DataFrame) -> DataFrame:
    """Both windows' features side by side (_ref, _det), 0 where a window lacks the pair."""
    values = [c for c in ref.columns if c not in ("window_index", *PAIR)]
    sides = [df.select(*PAIR, *(F.col(c).cast("double").alias(f"{c}_{s}") for c in values)) for df, s in ((ref, "ref"), (det, "det"))]
    return sides[0].join(sides[1], list(PAIR), "full").na.fill(0)


def long_features(merged: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """pair, feature, ref, det, and the pair's frequencies."""
    items = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"{f}_ref").alias("ref"), F.col(f"{f}_det").alias("det")) for f in features))
    return merged.select(*PAIR, F.col("frequency_ref").alias("f_ref"), F.col("frequency_det").alias("f_det"), F.explode(items).alias("x")).select(*PAIR, "f_ref", "f_det", "x.*")


def test_choice(long: DataFrame) -> DataFrame:
    """Adds share_ref, share_det, status (new, deleted, changed) and test (proportion, count, mean), chosen by all the
    values of a feature in both windows; rows of two zeros are left out."""
    w = Window.partitionBy("feature")
    unit = F.bool_and(F.col("ref").between(0, 1) & F.col("det").between(0, 1)).over(w)
    whole = F.bool_and((F.col("ref") == F.floor("ref")) & (F.col("det") == F.floor("det"))).over(w)
    t = long.withColumn("test", F.when(unit, "proportion").when(whole, "count").otherwise("mean"))
    for s in ("ref", "det"):
        total = F.sum(s).over(w)
        t = t.withColumn(f"total_{s}", total).withColumn(f"share_{s}", F.when(total != 0, F.col(s) / total).otherwise(0.0)).withColumn(f"std_{s}", F.coalesce(F.stddev_samp(s).over(w), F.lit(0.0)))
        t = t.withColumn(f"from_{s}", F.sum(f"f_{s}").over(Window.partitionBy("feature", "activity_from")))
    status = F.when((F.col("ref") > 0) & (F.col("det") == 0), "deleted").when((F.col("ref") == 0) & (F.col("det") > 0), "new").otherwise("changed")
    return t.filter("ref != 0 or det != 0").withColumn("status", status)


def test_statistics(t: DataFrame, pseudo: int = 5) -> DataFrame:
    """z of the proportion test, t and df of Welch's test, and both effect sizes (Cohen's h and d), in SQL."""
    n1, n2 = F.col("from_ref") + pseudo, F.col("from_det") + pseudo
    s1, s2 = F.col("ref") * F.col("from_ref") + pseudo, F.col("det") * F.col("from_det") + pseudo
    pooled = (s1 + s2) / (n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    z = F.when(F.col("ref") == F.col("det"), 0.0).when(se > 0, (s1 / n1 - s2 / n2) / se).otherwise(0.0)
    eps = 1e-8
    m1, m2 = F.greatest("f_ref", F.lit(1.0)), F.greatest("f_det", F.lit(1.0))
    v1, v2 = F.pow(F.col("std_ref"), 2) / m1, F.pow(F.col("std_det"), 2) / m2
    welch = (F.col("ref") - F.col("det")) / (F.sqrt(v1 + v2) + eps)
    df = F.pow(v1 + v2, 2) / (F.pow(v1, 2) / F.greatest(m1 - 1, F.lit(1.0)) + F.pow(v2, 2) / F.greatest(m2 - 1, F.lit(1.0)) + eps)
    h = 2 * (F.asin(F.sqrt(F.least(F.greatest(F.col("ref"), F.lit(0.0)), F.lit(1.0)))) - F.asin(F.sqrt(F.least(F.greatest(F.col("det"), F.lit(0.0)), F.lit(1.0)))))
    d = (F.col("det") - F.col("ref")) / (F.sqrt((F.pow(F.col("std_ref"), 2) + F.pow(F.col("std_det"), 2)) / 2) + eps)
    return t.withColumn("z", F.when(F.col("test") == "proportion", z)).withColumn("t", F.when(F.col("test") == "mean", welch)).withColumn("df", F.when(F.col("test") == "mean", df)).withColumn("effect", F.when(F.col("test") == "proportion", h).when(F.col("test") == "mean", d))


def significant_changes(ref: DataFrame, det: DataFrame, features: tuple[str, ...], *, p_value: float = 0.05, effect_size: float = 0.2, presence: float = 0.01, pseudo: int = 5, resource: tuple[str, ...] = (), data: tuple[str, ...] = ()) -> DataFrame:
    """Significant differences: transition, feature, perspective, transition_status, activity_status, p_value,
    effect_size, ref_value, det_value, dif_value."""
    from ..functions import stats

    t = test_choice(long_features(merge_windows(ref, det), features))
    t = test_statistics(t.filter((F.col("share_ref") >= presence) | (F.col("share_det") >= presence)), pseudo)
    whole = lambda c: F.col(c).cast("long")
    cells = (whole("ref"), whole("det"), (F.col("total_ref") - F.col("ref")).cast("long"), (F.col("total_det") - F.col("det")).cast("long"))
    for name, col in (("cell", F.struct(*(c.alias(f"c{i}") for i, c in enumerate(cells)))),):
        t = t.withColumn(name, col)
    counts = t.filter("test = 'count'").withColumn("p", stats.count_test_udf()(*(F.col(f"cell.c{i}") for i in range(4)))).withColumn("effect", stats.cramers_2x2_udf()(*(F.col(f"cell.c{i}").cast("double") for i in range(4))))
    props = t.filter("test = 'proportion'").withColumn("p", stats.norm_sf2_udf()(F.col("z")))
    means = t.filter("test = 'mean'").withColumn("p", stats.student_sf2_udf()(F.col("t"), F.col("df")))
    a = counts.unionByName(props).unionByName(means)
    a = a.withColumn("p", F.when(F.col("status") == "changed", F.col("p")).otherwise(0.0)).withColumn("effect", F.when(F.col("status") == "changed", F.col("effect")).otherwise(1.0))
    a = a.filter((F.col("status") != "changed") | ((F.col("p") < p_value) & (F.abs("effect") > effect_size)))
    a = a.join(F.broadcast(activity_status(ref, det)), list(PAIR), "left")
    views = F.create_map(*(F.lit(x) for f in features for x in (f, perspective_of(f, resource, data))))
    return a.select(F.struct(*PAIR).alias("transition"), "feature", views[F.col("feature")].alias("perspective"), F.col("status").alias("transition_status"), F.coalesce("activity_status", F.lit("")).alias("activity_status"), F.col("p").alias("p_value"), F.col("effect").alias("effect_size"), F.col("ref").alias("ref_value"), F.col("det").alias("det_value"), (F.col("det") - F.col("ref")).alias("dif_value"))


def activity_status(ref: DataFrame, det: DataFrame) -> DataFrame:
    """pair, activity_status: "new(a, b) | deleted(c)" for the pair's activities that only one window has."""
    acts = lambda df: df.select(F.explode(F.array(*PAIR)).alias("a")).distinct()
    new, gone = acts(det).join(acts(ref), "a", "left_anti"), acts(ref).join(acts(det), "a", "left_anti")
    pairs = ref.select(*PAIR).union(det.select(*PAIR)).distinct()
    tagged = new.withColumn("kind", F.lit("new")).union(gone.withColumn("kind", F.lit("deleted")))
    parts = pairs.withColumn("a", F.explode(F.array_distinct(F.array(*PAIR)))).join(tagged, "a").groupBy(*PAIR, "kind").agg(F.array_join(F.array_sort(F.collect_set("a")), ", ").alias("names"))
    text = parts.groupBy(*PAIR).agg(F.concat_ws(" | ", F.array_sort(F.collect_list(F.concat("kind", F.lit("("), "names", F.lit(")"))), lambda x, y: F.when(x > y, -1).otherwise(1))).alias("activity_status"))
    return text


def build_dfg(tm: DataFrame) -> DataFrame:
    """kind (edge, start, end), activity_from, activity_to, frequency. Activities that nothing leads to, or that lead
    nowhere, get an edge of weight 1 from or to an unknown activity."""
    e = tm.filter("frequency > 0").select(*PAIR, F.col("frequency").cast("long").alias("frequency"))
    kind = F.when(F.col("activity_from") == START, "start").when(F.col("activity_to") == END, "end").otherwise("edge")
    e = e.withColumn("kind", kind)
    inner = e.filter("kind = 'edge'")
    nodes = inner.select(F.explode(F.array(*PAIR)).alias("a")).distinct()
    has_in = inner.select(F.col("activity_to").alias("a")).union(e.filter("kind = 'start'").select(F.col("activity_to").alias("a")))
    has_out = inner.select(F.col("activity_from").alias("a")).union(e.filter("kind = 'end'").select(F.col("activity_from").alias("a")))
    no_in = nodes.join(has_in.distinct(), "a", "left_anti").select(F.lit(BEFORE).alias("activity_from"), F.col("a").alias("activity_to"))
    no_out = nodes.join(has_out.distinct(), "a", "left_anti").select(F.col("a").alias("activity_from"), F.lit(AFTER).alias("activity_to"))
    extra = no_in.union(no_out).select(F.lit("edge").alias("kind"), *PAIR, F.lit(1).cast("long").alias("frequency"))
    return e.select("kind", *PAIR, "frequency").union(extra)


def compare_dfgs(ref: DataFrame, det: DataFrame) -> DataFrame:
    """change_type (new_transitions, deleted_transitions, new_activities, deleted_activities), activity_from,
    activity_to (NULL for activities); artificial unknown activities don't count, and activities are those of edges."""
    real = ~F.col("activity_from").isin(BEFORE, AFTER) & ~F.col("activity_to").isin(BEFORE, AFTER)
    pairs = lambda d: d.filter(real).select(*PAIR).distinct()
    acts = lambda d: d.filter(real & (F.col("kind") == "edge")).select(F.explode(F.array(*PAIR)).alias("activity_from")).distinct()
    out = []
    for name, a, b in (("new", det, ref), ("deleted", ref, det)):
        out.append(pairs(a).exceptAll(pairs(b)).select(F.lit(f"{name}_transitions").alias("change_type"), *PAIR))
        out.append(acts(a).exceptAll(acts(b)).select(F.lit(f"{name}_activities").alias("change_type"), "activity_from", F.lit(None).cast("string").alias("activity_to")))
    r = out[0]
    for x in out[1:]:
        r = r.union(x)
    return r


def high_level_changes(changes: DataFrame, dfg_changes: DataFrame) -> DataFrame:
    """change_type, activity_from, activity_to: transitions with variations in each feature, and the graphs' changes."""
    v = changes.select(F.concat(F.lit("Transitions with variations in "), "feature").alias("change_type"), "transition.*")
    return v.union(dfg_changes)


def as_map(high_level: DataFrame) -> dict[str, list]:
    """The edge of the API: name to list, ["None"] where there is nothing."""
    out: dict[str, list] = {k: [] for k in ("new_transitions", "deleted_transitions", "new_activities", "deleted_activities")}
    for r in high_level.orderBy("change_type", "activity_from", "activity_to").collect():
        out.setdefault(r[0], []).append((r[1], r[2]) if r[2] is not None else r[1])
    return {k: v or ["None"] for k, v in out.items()}


def changed_activities(high_level: DataFrame) -> DataFrame:
    """Distinct activities that the high-level changes name."""
    return high_level.select(F.explode(F.array(*PAIR)).alias("activity")).filter("activity is not null").distinct()


def dfg_render(dfg_ref: DataFrame, dfg_det: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Edges with their colour (new blue, deleted red, changed orange, else black) and label."""
    a = dfg_ref.select(*PAIR, F.col("frequency").alias("ref"))
    b = dfg_det.select(*PAIR, F.col("frequency").alias("det"))
    e = a.join(b, list(PAIR), "full")
    if changes is not None:
        part = F.concat("feature", F.lit(" ("), F.concat_ws(", ", F.round("ref_value", 2).cast("string"), F.round("det_value", 2).cast("string"), F.round("p_value", 3).cast("string"), F.round("effect_size", 2).cast("string")), F.lit(")"))
        c = changes.select("transition.*", part.alias("part")).groupBy(*PAIR).agg(F.array_join(F.array_sort(F.collect_list("part")), "\n").alias("label"))
        e = e.join(c, list(PAIR), "left")
    else:
        e = e.withColumn("label", F.lit(None).cast("string"))
    colour = F.when(F.col("ref").isNull(), "blue").when(F.col("det").isNull(), "red").when(F.col("label").isNotNull(), "orange").otherwise("black")
    return e.select(*PAIR, F.coalesce("ref", F.lit(0)).cast("long").alias("ref"), F.coalesce("det", F.lit(0)).cast("long").alias("det"), colour.alias("colour"), F.coalesce("label", F.lit("")).alias("label"))


def dot(render: DataFrame) -> str:
    """Graphviz text of a rendered graph."""
    rows = render.orderBy(*PAIR).collect()
    quote = lambda x: '"' + str(x).replace('"', '\\"') + '"'
    return "digraph {\n" + "".join(f"  {quote(r[0])} -> {quote(r[1])} [color={r['colour']}, label={quote(r['label'] or r['det'])}]\n" for r in rows) + "}\n"
