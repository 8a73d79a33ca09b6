"""Process features: the transition matrix of every window at once, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import WindowSpec, in_windows, pane_windows

PAIR = ("activity_from", "activity_to")
KEY = ("window_index", *PAIR)
CONTROL_FLOW = ("frequency", "percentual", "probability", "causality", "parallel", "choice", "loop")
METHODS = ("time_avg", "time_std", "numerical_avg", "numerical_std", "categorical_unique", "categorical_entropy", "categorical_encoding_frequency", "categorical_encoding_probability")


def check_features(control_flow=(), pairs=()) -> None:
    if wrong := [f for f in control_flow if f not in CONTROL_FLOW] + [m for m, _ in pairs if m not in METHODS]:
        raise ValueError(f"unknown features: {', '.join(map(str, wrong))}")


def minutes(col: str = "ts"):
    """Minutes between a transition's events, below a second included."""
    return F.timestamp_diff("MICROSECOND", F.col(f"{col}_from"), F.col(f"{col}_to")) / F.lit(60_000_000.0)


def pair_mean(attr: str):
    return (F.col(f"{attr}_from").cast("double") + F.col(f"{attr}_to").cast("double")) / 2


def pair_value(attr: str):
    """``from->to``; NULL where a side is NULL."""
    return F.concat(F.col(f"{attr}_from").cast("string"), F.lit("->"), F.col(f"{attr}_to").cast("string"))


def _sums(rows: DataFrame, measures: dict) -> DataFrame:
    """Per window and pair: counts and, for each measure, its count, sum and squares about the mean.

    Windows that overlap share panes: rows are summed by pane once, and panes, of which there are far fewer than
    rows, are dealt to windows."""
    aggs = [F.count("*").alias("frequency")]
    for m in measures:
        aggs += [F.count(m).alias(f"n_{m}"), F.avg(m).alias(f"a_{m}"), F.var_pop(m).alias(f"v_{m}")]
    return rows.groupBy("pane", *PAIR).agg(*aggs)


def transition_matrix(log: DataFrame, spec: WindowSpec, n: int, *, threshold: float = 0, numeric: tuple[str, ...] = (), time: bool = False) -> DataFrame:
    """window_index, pair, frequency, percentual, probability, and avg and std of the times in minutes and of numeric
    attributes (0 where there is none).

    threshold below 1: pairs whose share is not above it are left out, else those whose frequency isn't above it;
    percentual isn't renormalised, probability is taken after the filter."""
    measures = ({"time": minutes()} if time else {}) | {a: pair_mean(a) for a in numeric}
    rows = log.withColumn("pane", F.floor(F.col("transition_id") / spec.pane())).select("pane", *PAIR, *(v.alias(k) for k, v in measures.items()))
    by = pane_windows(_sums(rows, measures), spec, n)
    # Squares are taken about the window's own mean, so that values far from 0 lose nothing.
    line = Window.partitionBy(*KEY)
    by = by.withColumns({f"m_{m}": F.sum(F.col(f"n_{m}") * F.col(f"a_{m}")).over(line) / F.nullif(F.sum(f"n_{m}").over(line), F.lit(0)) for m in measures})
    aggs = [F.sum("frequency").alias("frequency")]
    for m in measures:
        k, mean = F.sum(f"n_{m}"), F.sum(F.col(f"n_{m}") * F.col(f"a_{m}"))
        squares = F.sum(F.col(f"n_{m}") * (F.col(f"v_{m}") + F.pow(F.col(f"a_{m}") - F.col(f"m_{m}"), 2)))
        names = ("time_avg", "time_std") if m == "time" else (f"numerical_avg_{m}", f"numerical_std_{m}")
        aggs += [F.coalesce(mean / F.nullif(k, F.lit(0)), F.lit(0.0)).alias(names[0]), F.when(k > 1, F.sqrt(squares / F.nullif(k - 1, F.lit(0)))).otherwise(0.0).alias(names[1])]
    tm = by.groupBy(*KEY).agg(*aggs)
    tm = tm.withColumn("percentual", F.col("frequency") / F.sum("frequency").over(Window.partitionBy("window_index")))
    tm = tm.filter((F.col("percentual") if threshold < 1 else F.col("frequency")) > threshold)
    return tm.withColumn("probability", F.col("frequency") / F.sum("frequency").over(Window.partitionBy("window_index", "activity_from")))


def value_counts(log: DataFrame, spec: WindowSpec, n: int, attr: str) -> DataFrame:
    """How often each value pair of an attribute occurs, by window and pair; by panes as well."""
    rows = log.select(F.floor(F.col("transition_id") / spec.pane()).alias("pane"), *PAIR, pair_value(attr).alias("value_pair"))
    panes = rows.filter("value_pair is not null").groupBy("pane", *PAIR, "value_pair").agg(F.count("*").alias("frequency"))
    return pane_windows(panes, spec, n).groupBy(*KEY, "value_pair").agg(F.sum("frequency").alias("frequency"))


def encodings(log: DataFrame, spec: WindowSpec, n: int, attr: str) -> DataFrame:
    """Long form of the categorical encodings: frequency, and probability within the window's pair."""
    counts = value_counts(log, spec, n, attr)
    return counts.withColumn("probability", F.col("frequency") / F.sum("frequency").over(Window.partitionBy(*KEY)))


def wide(long: DataFrame, attr: str, method: str = "frequency") -> DataFrame:
    """One column for each value pair; only for the edge of an application, as the columns depend on the data."""
    name = F.concat(F.lit(f"categorical_encoding_{method}_{attr}_"), "value_pair")
    return long.withColumn("__c", name).groupBy(*KEY).pivot("__c").agg(F.first(method)).na.fill(0)


def categorical(log: DataFrame, spec: WindowSpec, n: int, attr: str) -> DataFrame:
    """categorical_unique (distinct value pairs) and categorical_entropy (base 2) by window and pair."""
    p = encodings(log, spec, n, attr)
    return p.groupBy(*KEY).agg(F.count("*").alias(f"categorical_unique_{attr}"), (-F.sum(F.col("probability") * F.log2("probability"))).alias(f"categorical_entropy_{attr}"))


def cycle_edges(edges: DataFrame, most: int = 4) -> DataFrame:
    """(window_index, a, b): self loops and the edges of simple cycles of at most ``most`` edges."""
    e = edges.select("window_index", F.col("activity_from").alias("a"), F.col("activity_to").alias("b")).distinct()
    path = e.filter("a != b")
    steps, out = path.select("window_index", F.array("a", "b").alias("p")), e.filter("a = b")
    following = path.select("window_index", F.col("a").alias("tail"), F.col("b").alias("head"))
    for _ in range(2, most + 1):
        steps = steps.withColumn("tail", F.element_at("p", -1)).join(following, ["window_index", "tail"])
        closed = steps.filter(F.col("head") == F.element_at("p", 1)).select("window_index", F.concat("p", F.array("head")).alias("p"))
        links = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.element_at("p", i).alias("a"), F.element_at("p", i + 1).alias("b")))
        out = out.union(closed.select("window_index", F.explode(links).alias("x")).select("window_index", "x.*"))
        steps = steps.filter(~F.array_contains("p", F.col("head"))).select("window_index", F.concat("p", F.array("head")).alias("p"))
    return out.distinct()


def alpha_relations(edges: DataFrame, max_loop: int = 4) -> DataFrame:
    """causality, parallel, choice and loop flags of each window's edges (window_index, activity_from, activity_to).

    causality: the only successor, and another activity. Base parallel: both directions exist, neither is causal, and
    the two have a common predecessor; the flag then marks every edge that touches such an activity unless it is
    causal. choice: out of an activity of several successors, neither causal nor base parallel. loop: a self loop or
    an edge of a simple cycle of at most ``max_loop`` edges, and not parallel. Edges are few (activities squared by
    window), so cycles are found by joins of bounded length."""
    e = edges.select("window_index", F.col("activity_from").alias("a"), F.col("activity_to").alias("b")).distinct()
    out = F.count("*").over(Window.partitionBy("window_index", "a"))
    e = e.withColumn("degree", out).withColumn("causality", ((F.col("degree") == 1) & (F.col("a") != F.col("b"))).cast("int"))
    flip = e.select("window_index", F.col("a").alias("b"), F.col("b").alias("a"), F.col("causality").alias("back"))
    both = e.join(flip, ["window_index", "a", "b"]).filter("a != b and causality = 0 and back = 0").select("window_index", "a", "b")
    into = e.select("window_index", F.col("a").alias("p"), F.col("b").alias("x"))
    common = into.withColumnRenamed("x", "a").join(into.withColumnRenamed("x", "b"), ["window_index", "p"]).select("window_index", "a", "b").distinct()
    base = both.join(common, ["window_index", "a", "b"], "left_semi").withColumn("base", F.lit(1))
    touched = base.select("window_index", F.col("a").alias("x")).distinct().withColumn("hit", F.lit(1))
    loops = cycle_edges(edges, max_loop).withColumn("cycle", F.lit(1))
    r = e.join(base, ["window_index", "a", "b"], "left").join(loops, ["window_index", "a", "b"], "left")
    r = r.join(touched.select("window_index", F.col("x").alias("a"), F.col("hit").alias("hit_a")), ["window_index", "a"], "left")
    r = r.join(touched.select("window_index", F.col("x").alias("b"), F.col("hit").alias("hit_b")), ["window_index", "b"], "left")
    causal, parallel = F.col("causality") == 1, (F.col("hit_a").isNotNull() | F.col("hit_b").isNotNull()) & (F.col("causality") == 0)
    choice = (F.col("degree") > 1) & ~causal & F.col("base").isNull()
    loop = F.col("cycle").isNotNull() & ~parallel & F.col("base").isNull()
    return r.select("window_index", F.col("a").alias("activity_from"), F.col("b").alias("activity_to"), "causality", parallel.cast("int").alias("parallel"), choice.cast("int").alias("choice"), loop.cast("int").alias("loop"))


def full_matrix(log: DataFrame, spec: WindowSpec, n: int, *, threshold: float = 0, numeric=(), time=False, categorical_attrs=(), alpha=False) -> DataFrame:
    """All features merged on window and pair; what a pair lacks is 0."""
    tm = transition_matrix(log, spec, n, threshold=threshold, numeric=tuple(numeric), time=time)
    out = tm
    if alpha:
        out = out.join(alpha_relations(tm), list(KEY), "left")
    for a in categorical_attrs:
        out = out.join(categorical(log, spec, n, a), list(KEY), "left")
    return out.na.fill(0)


__all__ = ["alpha_relations", "categorical", "check_features", "encodings", "full_matrix", "in_windows", "transition_matrix", "value_counts", "wide"]
