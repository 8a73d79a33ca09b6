"""N-gram Jaccard join by count vectors.

A document is its set of distinct 5-word shingles. Shingles are hashed into groups and a document becomes the point
of its group counts: two sets share at most the sum of the coordinate-wise minima of their points, so a pair whose
sum falls short of what the threshold asks for is dismissed without looking at the sets.

The index over all points is kept in blocks. A block holds the documents that have one shingle in common among the
first ``n - ceil(t n) + 1`` of their shingles; any two sets that reach the threshold t meet in a block, whatever the
order of shingles, and the order taken is by hash with the most frequent shingles last: a passage that many documents
share makes blocks only of those that hold little else. A shingle's place in the order bounds what can still follow,
so the block of a pair's first common shingle lets it through and most others don't.

Blocks of a few documents give their pairs at once, larger ones first only pairs of neighbours in size and of each
document with the one that has the fewest shingles before the block's. Pairs are
verified on the whole sets, by clusters of candidates so that each set travels once, and links make components. Then
the documents of a larger block that are outside its largest component are looked up in a packed R-tree over the
points of the block (boxes are coordinate maxima): what the bounds let through between different components is
verified too. A lookup that finds more than a few pairs for each document gives a spanning forest of them, and its
block is looked up again once these have made larger components; what a few such rounds leave is verified where it is
found, with the sets at hand. So no task's result outgrows what it reads. Equal sets are one node from the start. No
link between different components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import NO_ID, id_back, id_key, stage
from ._graph import Union, components
from ._tokens import release
from ._words import rolling, word_hashes

#: Groups of a point, and of the folded point that boxes and the first bound take.
GROUPS, BOX_GROUPS = 1024, 128
#: Blocks up to this size give all pairs at once.
SMALL = 8
#: Shingles of more documents than this come last in the order of shingles, and so many of them at most; the others
#: keep their place, which costs time but no links.
FREQUENT, FREQUENT_MOST = 16, 500_000
#: Candidate clusters up to this size are verified in one place, larger ones pair by pair.
CLUSTER = 1_000
#: Documents of a block that one task looks up, and among how many.
QUERIES, TARGETS = 1_000, 2_000
#: Pairs for each document that a lookup gives; beyond it, a spanning forest of them. Rounds of lookups for these.
PAIRS_EACH, ROUNDS = 16, 3
LEAF = 32
#: log2 of the bits that tell which texts are worth hashing again; more candidates only make it less choosy.
BLOOM_BITS = 24


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of k words; fewer words are one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(word_hashes(words), min(k, len(words))))


def need(n: int, t: int) -> int:
    """Shingles that a set of n shares at least with any set of a similarity of t percent."""
    return -(-t * n // 100)


def pack_point(p: np.ndarray) -> bytes:
    most = int(p.max(initial=0))
    return p.astype("u1" if most < 256 else "<u2" if most < 65_536 else "<u4").tobytes()


def unpack_points(raw: list[bytes], groups: int) -> np.ndarray:
    return np.stack([np.frombuffer(x, {1: "u1", 2: "<u2", 4: "<u4"}[len(x) // groups]).astype(np.int32) for x in raw])


def counts(s: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((s >> np.uint64(32)).astype(np.int64) % groups, minlength=groups)


def fold(points: np.ndarray) -> np.ndarray:
    """Points of BOX_GROUPS from points of GROUPS: their groups added up."""
    return points.reshape(*points.shape[:-1], GROUPS // BOX_GROUPS, BOX_GROUPS).sum(-2)


def survive(points_a: np.ndarray, points_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, t: int) -> np.ndarray:
    """Whether the summed coordinate minima reach the overlap that a similarity of t percent asks for."""
    most = np.minimum(points_a, points_b).sum(-1)
    return (100 + t) * most >= t * (n_a + n_b)


class RTree:
    """A packed tree of two levels over points: leaves of ``LEAF`` neighbours in size, bounded by the coordinate
    maxima of their folded points and by their least size."""

    def __init__(self, points: np.ndarray, n: np.ndarray):
        self.order = np.lexsort((points[:, 0], n))
        self.points, self.n = points[self.order], n[self.order]
        self.cuts = np.arange(0, len(n), LEAF)
        self.top = np.maximum.reduceat(fold(self.points), self.cuts, axis=0)
        self.least = np.minimum.reduceat(self.n, self.cuts)

    def search(self, point: np.ndarray, n: int, allowed: np.ndarray, t: int) -> np.ndarray:
        """Of the points (as given) that are allowed, the positions that the bounds let through."""
        allowed = allowed[self.order]
        leaves = np.flatnonzero(np.logical_or.reduceat(allowed, self.cuts))
        if len(leaves):
            leaves = leaves[(100 + t) * np.minimum(self.top[leaves], fold(point)).sum(1) >= t * (n + self.least[leaves])]
        if not len(leaves):
            return leaves
        at = (self.cuts[leaves][:, None] + np.arange(LEAF)).ravel()
        at = at[at < len(self.n)]
        at = at[allowed[at]]
        return self.order[at[survive(self.points[at], point, self.n[at], n, t)]]


def reaches(n_a, i_a, n_b, i_b, t: int):
    """Whether sets that have no common shingle before places i_a and i_b of their orders can be as similar as t
    percent; for numbers, arrays and columns. A pair that is passes at its first common shingle, wherever else it
    fails."""
    return ((100 + t) * (n_a - i_a) >= t * (n_a + n_b)) & ((100 + t) * (n_b - i_b) >= t * (n_a + n_b))


def _prefix(s: np.ndarray, t: int, frequent: np.ndarray | None = None) -> np.ndarray:
    n = len(s) - need(len(s), t) + 1 if len(s) else 0
    if frequent is not None and len(frequent) and n:
        last = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
        if last.any():
            s = np.concatenate([s[~last], s[last]])
    return s[:n].copy()  # not a view, which would hold the whole set


def _frequent(docs: DataFrame, k: int, t: int) -> np.ndarray:
    """The shingles of most documents among the first of each document by hash, sorted."""

    def run(batches):
        release()
        for b in batches:
            held = [_prefix(shingles(text.as_py(), k), t) for text in b.column(0)]
            token, n = np.unique(np.concatenate([*held, np.empty(0, np.uint64)]), return_counts=True)
            for at in range(0, len(token), 100_000):
                yield pa.RecordBatch.from_pydict({"token": token[at : at + 100_000].view(np.int64), "n": n[at : at + 100_000].astype(np.int64)})

    counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") > FREQUENT).orderBy(F.desc("n"), "token").limit(FREQUENT_MOST).select("token")
    return np.sort(top.toArrow().column(0).to_numpy().view(np.uint64))


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _signatures(docs: DataFrame, k: int, t: int) -> DataFrame:
    last = docs.sparkSession.sparkContext.broadcast(_frequent(docs, k, t))

    def run(batches):
        release()
        for b in (b.slice(at, 1_000) for b in batches for at in range(0, b.num_rows, 1_000)):
            n, digest, point, prefix = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, k)
                n.append(len(s))
                digest.append(_digest(s))
                point.append(pack_point(counts(s)))
                prefix.append(_prefix(s, t, last.value).view(np.int64))
            sizes = np.cumsum([0, *map(len, prefix)])
            lists = pa.LargeListArray.from_arrays(pa.array(sizes, pa.int64()), pa.array(np.concatenate([*prefix, np.empty(0, np.int64)]))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({"doc": b.column(0), "hash": b.column(2), "n": pa.array(n, pa.int64()), "digest": pa.array(digest, pa.binary()), "point": pa.array(point, pa.binary()), "prefix": lists})

    return docs.select("doc", "text", F.xxhash64("text").alias("hash")).mapInArrow(run, "doc long, hash long, n long, digest binary, point binary, prefix array<long>")


def _bloom(ids: DataFrame) -> np.ndarray:
    """Bits of the ids, gathered as words of 32 bits: 2 ** (BLOOM_BITS - 5) rows at most, however many ids."""
    hashes = F.explode(F.array(F.xxhash64("doc"), F.xxhash64("doc", F.lit(1))))
    rows = ids.select(hashes.alias("h")).withColumn("h", F.pmod("h", F.lit(1 << BLOOM_BITS))).groupBy(F.shiftright("h", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 31 as int))")).alias("x"))
    out = np.zeros(1 << (BLOOM_BITS - 5), np.uint32)
    found = rows.toArrow()
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint32)
    return out


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc, digest, set): whole shingle sets of the documents in ids (doc), and of a few others; texts aren't shuffled
    for it, as bits of the ids tell which to hash again."""
    bits = docs.sparkSession.sparkContext.broadcast(_bloom(ids))
    h = [F.pmod(x, F.lit(1 << BLOOM_BITS)) for x in (F.xxhash64("doc"), F.xxhash64("doc", F.lit(1)))]

    def run(batches):
        b32 = bits.value
        for b in batches:
            maybe = np.ones(b.num_rows, bool)
            for c in (2, 3):
                x = b.column(c).to_numpy(zero_copy_only=False)
                maybe &= (b32[x >> 5] >> (x & 31).astype(np.uint32)) & 1 == 1
            at = pa.array(np.flatnonzero(maybe))
            doc, text = b.column(0).take(at), b.column(1).take(at).to_pylist()
            for k0 in range(0, len(text), 1_000):
                sets = [shingles(x, k) for x in text[k0 : k0 + 1_000]]
                yield pa.RecordBatch.from_pydict({"doc": doc.slice(k0, 1_000), "digest": pa.array(map(_digest, sets), pa.binary()), "set": pa.array([s.tobytes() for s in sets], pa.binary())})

    return docs.select("doc", "text", h[0].alias("h0"), h[1].alias("h1")).mapInArrow(run, "doc long, digest binary, set binary")


def _by_node(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set); of rows that repeat id and set, one."""
    return sets.join(nodes, ["doc", "digest"]).select("node", "set").dropDuplicates(["node"])


def similar(x: bytes, y: bytes, t: int) -> bool:
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = np.sort(np.concatenate([p, q]), kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= t * (len(p) + len(q) - same)


def _pairs_table(out: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def _one_by_one(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The similar ones among the pairs."""

    def each(batches):
        for b in batches:
            ok = [similar(x, y, t) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_pydict({"a": b.column(0).take(at), "b": b.column(1).take(at)})

    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    return x.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(each, "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, t: int) -> DataFrame:
    """Links among the pairs that make the same components as all of them."""
    cluster = components(pairs)
    size = cluster.groupBy("component").agg(F.count("*").alias("size")).withColumnRenamed("component", "c")
    cluster = stage(cluster.join(size, F.col("component") == F.col("c")).join(nodes, "node").select("node", "doc", "digest", "component", "size"), "clusters")
    sets = stage(_sets(docs, cluster, k), "sets")
    of = pairs.join(cluster.select(F.col("node").alias("a"), F.col("component").alias("left_of"), "size"), "a")

    def within(key, pair, sets_):
        held = dict(zip(sets_.column("node").to_pylist(), sets_.column("set").to_pylist(), strict=True))  # repeats are equal
        up, out = Union(), []
        for a, b in zip(pair.column("a").to_pylist(), pair.column("b").to_pylist(), strict=True):
            if up.root(a) != up.root(b) and similar(held[a], held[b], t):
                up.join(a, b)
                out.append((a, b))
        return _pairs_table(out)

    small = cluster.filter(f"size <= {CLUSTER}").select("node", "doc", "digest", F.col("component").alias("right_of"))
    mine = sets.join(small, ["doc", "digest"]).select("right_of", "node", "set")
    found = of.filter(f"size <= {CLUSTER}").select("left_of", "a", "b").groupBy("left_of").cogroup(mine.groupBy("right_of")).applyInArrow(within, "a long, b long")
    rest = of.filter(f"size > {CLUSTER}").select("a", "b")
    if cluster.filter(f"size > {CLUSTER}").isEmpty():
        return found
    # Of a large cluster, first one pair of each node; only what these links leave apart is looked at in full.
    sets = _by_node(sets, cluster.filter(f"size > {CLUSTER}"))
    first = stage(_one_by_one(rest.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, t), "links")
    left = _apart(rest, stage(components(first), "components"))
    return found.union(first).union(_one_by_one(left, sets, t))


def _bounded(pairs: DataFrame, points: DataFrame, t: int) -> DataFrame:
    """Pairs whose summed minima reach the threshold."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                n = [b.column(c).to_numpy(zero_copy_only=False) for c in (2, 4)]
                x, y = (unpack_points(b.column(c).to_pylist(), GROUPS) for c in (3, 5))
                yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(np.flatnonzero(survive(x, y, n[0], n[1], t)))) for c in (0, 1)], ["a", "b"])

    for side in ("a", "b"):
        pairs = pairs.join(points.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("point").alias(f"point_{side}")), side)
    return pairs.select("a", "b", "n_a", "point_a", "n_b", "point_b").mapInArrow(run, "a long, b long")


def _chunk(at: Column, size: int) -> Column:
    return F.floor((at - 1) / size)


def _across(large: DataFrame, comp: DataFrame, points: DataFrame, t: int, sets: DataFrame | None = None, nodes: bool = False) -> DataFrame:
    """(a, b, token): pairs between different components of the large blocks (token, node, n, i) that the bounds let
    through; token only in a row of its own, where a task gave a spanning forest of too many. With ``sets`` the pairs
    are verified, and those given make the same components as all of them. With ``nodes``, only the nodes of the
    pairs, as a, and token."""
    own = large.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = own.groupBy("token", "component").agg(F.count("*").alias("size"), F.min("n").alias("least"))
    of = of.groupBy("token").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("kinds"), F.min("least").alias("least"), F.sum("size").alias("members")).filter("kinds > 1")
    # A document whose shingle stands too late for the smallest of the block meets none there.
    rows = own.join(of.select("token", F.col("top.component").alias("main"), "least", "members"), "token").filter(((100 + t) * (F.col("n") - F.col("i")) >= t * (F.col("n") + F.col("least"))))
    line = Window.partitionBy("token", F.col("component") != F.col("main")).orderBy("n", "node")
    rows = rows.withColumn("at", F.row_number().over(line)).withColumn("query", F.col("component") != F.col("main"))
    split = F.col("members") > TARGETS
    rows = rows.withColumn("t_chunk", F.when(split, _chunk(F.col("at"), TARGETS))).withColumn("q_chunk", F.when(split & F.col("query"), _chunk(F.col("at"), QUERIES)))
    rows = stage(rows.select("token", "node", "n", "i", "component", "query", "t_chunk", "q_chunk"), "mixed")
    # A block of moderate size is one task, and each of its rows goes there once.
    no = F.lit(None).cast("long")
    whole = rows.filter("t_chunk is null").select("token", no.alias("q_chunk"), F.lit(None).cast("boolean").alias("side"), no.alias("t_chunk"), "node", "n", "i", "component", F.col("query").alias("asks"), F.lit(True).alias("target"))
    rows = rows.filter("t_chunk is not null")
    span = lambda by, s: rows.filter(F.col(by[-1]).isNotNull()).groupBy("token", *by).agg(F.min("n").alias(f"lo_{s}"), F.max("n").alias(f"hi_{s}"))
    near = (100 * F.col("hi_q") >= t * F.col("lo_t")) & (100 * F.col("hi_t") >= t * F.col("lo_q"))
    tasks = stage(span(["query", "t_chunk"], "t").withColumnRenamed("query", "side").join(span(["q_chunk"], "q"), "token").filter(near).select("token", "q_chunk", "side", "t_chunk"), "tasks")
    found = rows.filter("query").drop("query", "t_chunk").join(tasks, ["token", "q_chunk"]).withColumn("asks", F.lit(True)).withColumn("target", F.lit(False))
    among = rows.drop("q_chunk").withColumnRenamed("query", "side").join(tasks, ["token", "side", "t_chunk"]).withColumn("asks", F.lit(False)).withColumn("target", F.lit(True))
    full = whole.unionByName(found).unionByName(among).join(points.select("node", "point"), "node")
    each, verified = PAIRS_EACH, sets is not None
    if verified:
        full = full.join(sets, "node")

    def run(key, table):
        node, n, i, comp_, asks, target = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "i", "component", "asks", "target"))
        qs, ts = np.flatnonzero(asks), np.flatnonzero(target)
        ok = (comp_[qs][:, None] != comp_[ts]) & (100 * np.minimum(n[qs][:, None], n[ts]) >= t * np.maximum(n[qs][:, None], n[ts])) & reaches(n[qs][:, None], i[qs][:, None], n[ts], i[ts], t)
        raw, out, tree = table.column("point").to_pylist(), [], None
        for q in np.flatnonzero(ok.any(1)).tolist():
            tree = tree or RTree(unpack_points([raw[x] for x in ts.tolist()], GROUPS), n[ts])
            hit = ts[tree.search(unpack_points([raw[qs[q]]], GROUPS)[0], int(n[qs[q]]), ok[q], t)]
            out += [(int(qs[q]), x) for x in hit.tolist()]
        if nodes:
            hit = node[np.unique(np.array(out, np.int64).ravel())]
            return pa.table({"a": pa.array(hit, pa.int64()), "b": pa.nulls(len(hit), pa.int64()), "token": pa.array([key[0].as_py()] * len(hit), pa.int64())})
        up, forest = Union(), []
        check = table.column("set").to_pylist() if verified else None
        over = not verified and len(out) > each * len(node)
        for x, y in out if verified or over else ():
            a, b = int(comp_[x]), int(comp_[y])
            if up.root(a) != up.root(b) and (not verified or similar(check[x], check[y], t)):
                up.join(a, b)
                forest.append((x, y))
        pairs = np.array(forest if verified or over else out, np.int64).reshape(-1, 2)
        x, y = node[pairs[:, 0]], node[pairs[:, 1]]
        none = np.full(int(over), None)
        return pa.table({"a": pa.array([*np.minimum(x, y).tolist(), *none], pa.int64()), "b": pa.array([*np.maximum(x, y).tolist(), *none], pa.int64()), "token": pa.array([*[None] * len(x), *[key[0].as_py()] * over], pa.int64())})

    return full.groupBy("token", "q_chunk", "side", "t_chunk").applyInArrow(run, "a long, b long, token long").distinct()


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs between different components."""
    for side in ("a", "b"):
        pairs = pairs.join(comp.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}")), side, "left")
    return pairs.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def jaccard_join(docs: DataFrame, *, k: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text", with_first: bool = False) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id: the smallest doc_id reachable by links of at least
    ``threshold`` percent Jaccard similarity between sets of distinct k-word shingles, ASCII letters in lower case.
    With ``with_first`` also text_hash (xxhash64 of the text's bytes) and first: whether the row is the first of its
    component, by doc_id; of several such rows, one is.

    A text with fewer words is one shingle; one without words, or NULL, has none and links with nothing. Each row is a
    document of its own, also where a doc_id repeats; a NULL doc_id counts as the smallest id and shows as NULL. Texts
    of any length are taken whole; the order of rows and ties of size don't change the result; other columns are left
    alone. An empty table gives no rows."""
    rows = docs.select(id_key(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    # Row numbers are written down with the signatures, so they hold whatever runs again later.
    sig = stage(_signatures(rows, k, threshold).withColumn("row", F.monotonically_increasing_id()), "signatures")
    some = sig.filter("n > 0")
    # Equal sets are one node: the row of the smallest id.
    reps = stage(some.groupBy("digest").agg(F.min(F.struct("doc", "row")).alias("x")).select("digest", F.col("x.doc").alias("doc"), F.col("x.row").alias("node")), "representatives")
    # By merge at every size, as the nodes grow with the documents; once, as both prefixes and points are wanted.
    ours = stage(some.select(F.col("row").alias("node"), "n", "point", "prefix").join(reps.select("node").hint("merge"), "node", "left_semi"), "nodes")
    tokens = ours.select("node", "n", F.posexplode("prefix").alias("i", "token"))
    counted = tokens.withColumn("size", F.count("*").over(Window.partitionBy("token"))).filter("size > 1")
    blocks = stage(counted, "blocks")
    line = Window.partitionBy("token").orderBy("n", "node")
    near = blocks.withColumn("next", F.array_compact(F.array(*(F.when((F.col("size") <= SMALL) | F.lit(j <= 2), F.lead(F.struct("node", "n", "i"), j).over(line)) for j in range(1, SMALL)))))
    met = near.select("size", "node", "n", "i", F.explode("next").alias("o"))
    # The document of the fewest shingles before this one has the least that others don't have.
    centre = blocks.filter(f"size > {SMALL}").groupBy("token").agg(F.min(F.struct("i", "node", "n")).alias("o"))
    met = met.unionByName(blocks.join(centre, "token").select("size", "node", "n", "i", F.struct("o.node", "o.n", "o.i").alias("o")))
    met = met.filter((100 * F.least("n", "o.n") >= threshold * F.greatest("n", "o.n")) & (F.col("node") != F.col("o.node")) & ((F.col("size") > SMALL) | reaches(F.col("n"), F.col("i"), F.col("o.n"), F.col("o.i"), threshold)))
    pairs = met.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).distinct()
    points = ours.select("node", "n", "point")
    pairs = stage(_bounded(pairs, points, threshold), "pairs")
    large = blocks.filter(f"size > {SMALL}").select("token", "node", "n", "i")

    links = stage(_verify(pairs, rows, reps, k, threshold), "links")
    comp = stage(components(links), "components")
    for _ in range(ROUNDS):
        more = stage(_across(large, comp, points, threshold), "pairs")
        apart = more.filter("token is null").select("a", "b")
        if apart.isEmpty():
            break
        found = stage(_verify(apart, rows, reps, k, threshold), "links")
        if not found.isEmpty():
            links = links.union(found)
            comp = stage(components(links), "components")
        # A block that gave all its pairs is done with.
        full = more.filter("token is not null").select("token").distinct()
        if full.isEmpty():
            break
        large = stage(large.join(full, "token", "left_semi"), "blocks")
    else:
        near = _across(large, comp, points, threshold, nodes=True)
        again = stage(large.join(near.select("token", F.col("a").alias("node")), ["token", "node"], "left_semi"), "blocks")
        some = reps.join(again.select("node").distinct(), "node")
        sets = stage(_by_node(_sets(rows, some, k), some), "sets")
        found = stage(_across(again, comp, points, threshold, sets).select("a", "b"), "links")
        comp = stage(components(links.union(found)), "components")
    first = reps.join(comp, "node").groupBy("component").agg(F.min(F.struct("doc", "node")).alias("first"))
    of = reps.join(comp, "node", "left").join(stage(first, "first"), "component", "left").select("digest", F.coalesce("first", F.struct("doc", "node")).alias("first"))
    out = sig.select("doc", "hash", "n", "digest", "row").join(stage(of, "classes"), "digest", "left")
    # Rows of the digest of no shingles aren't in a class.
    out = out.withColumn("first", F.coalesce("first", F.struct("doc", F.col("row").alias("node"))))
    extra = [F.col("hash").alias("text_hash"), (F.col("row") == F.col("first.node")).alias("first")] if with_first else []
    return out.select(id_back("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.col("first.doc"), F.lit(NO_ID)).alias("component_id"), *extra)
