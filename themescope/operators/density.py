"""Density clustering: mutual reachability, spanning tree, condensed hierarchy.

After Campello, Moulavi and Sander (2013). Equal vectors are held once with
their number of copies, so a stack of copies costs one point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from themescope.operators.components import connected, follow
from themescope.operators.neighbors import Index, build_index, knn, search
from themescope.operators.rows import join_repeated, rank_in_group
from themescope.session import cut_lineage

# Edges of the spanning tree put in order by one task at a time.
PACK_EDGES = 200_000


def default_min_cluster_size(n_rows: int) -> int:
    return max(100, int(n_rows * 0.005))


def neighbour_count(min_cluster_size: int) -> int:
    return min(5, max(1, min_cluster_size // 2))


def distinct_points(rows: DataFrame) -> DataFrame:
    """``(id, vec, copies)``: equal vectors once, named by their lowest row id."""
    return rows.groupBy("vec").agg(F.min("row_id").alias("id"), F.count(F.lit(1)).alias("copies"))


def core_distances(neighbours: DataFrame, points: DataFrame, min_samples: int) -> DataFrame:
    """``(id, core)``: distance to the min_samples-th other row, copies counted.

    With fewer other rows than that, the distance to the furthest one.
    """
    w = W.partitionBy("qid").orderBy("w", "id").rowsBetween(W.unboundedPreceding, 0)
    copies = points.select("id", "copies")
    reached = neighbours.join(copies, "id").withColumn("_rows", F.sum("copies").over(w))
    own = points.select(F.col("id").alias("qid"), F.col("copies").alias("_own"))
    ranked = own.join(reached, "qid", "left").withColumn(
        "_enough", F.coalesce(F.col("_rows"), F.lit(0)) + F.col("_own") - 1 >= min_samples
    )
    return (
        ranked.groupBy(F.col("qid").alias("id"))
        .agg(
            F.max(F.col("_own") - 1).alias("_same"),
            F.min(F.when(F.col("_enough"), F.col("w"))).alias("_at"),
            F.max("w").alias("_last"),
        )
        .select(
            "id",
            F.when(F.col("_same") >= min_samples, F.lit(0.0))
            .otherwise(F.coalesce("_at", "_last", F.lit(0.0)))
            .alias("core"),
        )
    )


def reach_edges(neighbours: DataFrame, cores: DataFrame) -> DataFrame:
    """``(src, dst, w)`` over neighbour lists, w = mutual reachability distance."""
    a = cores.select(F.col("id").alias("qid"), F.col("core").alias("_a"))
    b = cores.select("id", F.col("core").alias("_b"))
    return (
        neighbours.join(a, "qid")
        .join(b, "id")
        .select(F.col("qid").alias("src"), F.col("id").alias("dst"), F.greatest("w", "_a", "_b").alias("w"))
    )


def _edge_key(src: str, dst: str, w: str = "w"):
    """Edges in a strict order: weight, then lower and higher end."""
    return F.struct(
        F.col(w).alias("w"), F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")
    )


def spanning_tree(index: Index, neighbours: DataFrame, cores: DataFrame) -> DataFrame:
    """``(w, a, b)``: the minimum spanning tree under mutual reachability.

    Each block first joins its points as far as no edge out of the block can be lighter. Then
    rounds of Borůvka. A point's or component's lightest edge out is taken from the
    neighbour lists when nothing outside them can be as light: an unlisted
    partner of a point is at least as far as the last listed one. Only points
    for which that does not settle it are searched for, within the weight
    already known, skipping blocks that lie inside the point's own component.
    """
    n_points = cores.count()
    listed = cut_lineage(reach_edges(neighbours, cores))
    floor = (
        neighbours.groupBy(F.col("qid").alias("id"))
        .agg(F.count(F.lit(1)).alias("_n"), F.max("w").alias("_far"))
        .withColumn("_far", F.when(F.col("_n") >= n_points - 1, float("inf")).otherwise(F.col("_far")))
    )
    points = cut_lineage(
        cores.join(floor, "id", "left").select(
            "id",
            "core",
            F.greatest(F.coalesce("_far", F.lit(float("inf"))), F.col("core")).alias("floor"),
        )
    )
    joined = _joined_blocks(index, cores, listed, points)
    tree: list[DataFrame] = [joined.where("a IS NOT NULL").select("w", "a", "b")]
    comps = cut_lineage(joined.where("a IS NULL").select("id", "comp"))
    if comps.select("comp").distinct().limit(2).count() < 2:
        return tree[0]
    vectors = index.points.select("id", "vec")
    # Both directions, so that a component also sees lists that name it.
    live = cut_lineage(listed.union(listed.select("dst", "src", "w")).distinct())
    while True:
        one = comps.select("comp").distinct().limit(2).count()
        if one < 2:
            break
        ends = comps.select(F.col("id").alias("src"), F.col("comp").alias("cs"))
        others = comps.select(F.col("id").alias("dst"), F.col("comp").alias("cd"))
        live = cut_lineage(
            live.select("src", "dst", "w")
            .join(ends, "src")
            .join(others, "dst")
            .where(F.col("cs") != F.col("cd"))
        )
        known = live.groupBy(F.col("cs").alias("comp")).agg(F.min(_edge_key("src", "dst")).alias("best"))
        state = points.join(comps, "id")
        doubtful = (
            state.join(known, "comp", "left")
            .withColumn("bound", F.coalesce(F.col("best.w"), F.lit(float("inf"))))
            .where((F.col("floor") <= F.col("bound")) & (F.col("floor") < float("inf")))
            .select("id", "core", "comp", "bound")
        )
        doubtful = cut_lineage(doubtful)
        found = _outside(index, vectors, state, doubtful)
        offers = live.select(F.col("cs").alias("comp"), "src", "dst", "w")
        if found is not None:
            offers = offers.unionByName(found)
        picks = cut_lineage(
            offers.groupBy("comp").agg(F.min(_edge_key("src", "dst")).alias("e")).select("comp", "e.*")
        )
        tree.append(picks.select("w", "a", "b").distinct())
        # Hook each component to the other end of its edge; of two that chose the
        # same edge the lower one is the root.
        pairs = (
            picks.join(comps.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a")
            .join(comps.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
            .withColumn("to", F.when(F.col("ca") == F.col("comp"), F.col("cb")).otherwise(F.col("ca")))
            .select("comp", "to", "a", "b")
        )
        back = pairs.select(
            F.col("comp").alias("to"), F.col("to").alias("comp"), F.col("a").alias("a2"), F.col("b").alias("b2")
        )
        mutual = (F.col("a2") == F.col("a")) & (F.col("b2") == F.col("b")) & (F.col("comp") < F.col("to"))
        pointers = pairs.join(back, ["comp", "to"], "left").select(
            F.col("comp").alias("node"),
            F.when(F.coalesce(mutual, F.lit(False)), F.col("comp")).otherwise(F.col("to")).alias("ptr"),
        )
        roots = follow(pointers).withColumnRenamed("node", "comp")
        comps = cut_lineage(comps.join(roots, "comp").select("id", F.col("root").alias("comp")))
    out = tree[0]
    for part in tree[1:]:
        out = out.unionByName(part)
    return cut_lineage(out)


_JOINED = "id bigint, comp bigint, w double, a bigint, b bigint"


def _joined_blocks(index: Index, cores: DataFrame, listed: DataFrame, floors: DataFrame) -> DataFrame:
    """Spanning edges ``(w, a, b)`` that each block finds by itself, and ``(id, comp)`` of all points."""
    points = index.points.select("id", "block", "vec").join(cores, "id")
    away = cores.sparkSession.createDataFrame([], "id bigint, toward bigint, outside double")
    if len(index.block) > 1:
        away = _away(index, cores, listed, floors)
    rows = points.join(away, "id", "left")
    return cut_lineage(rows.groupBy("block").applyInPandas(_join_block, _JOINED))


def _away(index: Index, cores: DataFrame, listed: DataFrame, floors: DataFrame) -> DataFrame:
    """``(id, toward, outside)``: each point's lightest edge out of its block.

    ``listed`` is ``(src, dst, w)`` and ``floors`` ``(id, core, floor)``: edges that a point does not list
    weigh its floor at least. Points whose listed edges out are not lighter are searched for, within their weight.
    """
    held = index.points.select("id", F.col("block").alias("comp"))
    ends = held.select(F.col("id").alias("src"), F.col("comp").alias("cs"))
    others = held.select(F.col("id").alias("dst"), F.col("comp").alias("cd"))
    near = cut_lineage(
        listed.join(ends, "src").join(others, "dst").where("cs <> cd")
        .groupBy(F.col("src").alias("id"))
        .agg(F.min(F.struct("w", "dst")).alias("best"))
        .select("id", F.col("best.w").alias("w"), F.col("best.dst").alias("toward"))
    )
    bound = F.coalesce("w", F.lit(float("inf")))
    open_points = cut_lineage(
        floors.join(near.select("id", "w"), "id", "left")
        .where((F.col("floor") <= bound) & (F.col("floor") < float("inf")))
        .select("id", "core", bound.alias("bound"))
    )
    offers = near
    if not open_points.isEmpty():
        asked = open_points.join(index.points.select("id", "vec", F.col("block").alias("comp")), "id")
        found = search(index, asked.withColumnRenamed("id", "qid"), 1, traits=cores.join(held, "id"))
        offers = near.unionByName(found.select(F.col("qid").alias("id"), "w", F.col("id").alias("toward")))
    best = offers.groupBy("id").agg(F.min(F.struct("w", "toward")).alias("best"))
    return best.select("id", F.col("best.toward").alias("toward"), F.col("best.w").alias("outside"))


def _join_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Borůvka within a block; a component stops where its lightest edge may lead out of the block.

    Edges are in the order of ``_edge_key``: weight, then lower and higher end.
    """
    rows = rows.sort_values("id", ignore_index=True)
    ids, core = rows["id"].to_numpy(), rows["core"].to_numpy()
    vec = np.stack(rows["vec"].to_numpy()).astype(np.float64)
    n = len(ids)
    w = np.empty((n, n))
    for i in range(n):  # differences, as the search weighs them
        gap = vec - vec[i]
        w[i] = np.sqrt((gap * gap).sum(1))
    w = np.maximum(w, np.maximum(core[:, None], core[None, :]))
    np.fill_diagonal(w, np.inf)
    toward = rows["toward"].fillna(-1).to_numpy().astype(np.int64)
    outside = rows["outside"].fillna(np.inf).to_numpy()
    out_low, out_high = np.minimum(ids, toward), np.maximum(ids, toward)
    comp = np.arange(n)
    edges: list[tuple] = []
    while True:
        near = w.argmin(1)  # of equal weights the lowest id
        weight = w[np.arange(n), near]
        low, high = np.minimum(ids, ids[near]), np.maximum(ids, ids[near])
        inner = _first_by(comp, weight, low, high)
        outer = _first_by(comp, outside, out_low, out_high)
        chosen = []
        for i, o in zip(inner.tolist(), outer.tolist(), strict=True):
            inside = np.isfinite(weight[i]) and (
                not np.isfinite(outside[o]) or (weight[i], low[i], high[i]) < (outside[o], out_low[o], out_high[o])
            )
            if inside:
                chosen.append((i, int(near[i])))
        if not chosen:
            break
        for i, j in chosen:
            a, b = comp[i], comp[j]
            if a != b:  # two may have chosen the same edge
                edges.append((float(w[i, j]), *sorted((int(ids[i]), int(ids[j])))))
                comp[comp == max(a, b)] = min(a, b)
        for c in {int(comp[i]) for i, _ in chosen}:
            mine = np.flatnonzero(comp == c)
            w[np.ix_(mine, mine)] = np.inf
    points = pd.DataFrame({"id": ids, "comp": ids[comp]})
    found = pd.DataFrame(edges, columns=["w", "a", "b"])
    both = pd.concat([points, found], ignore_index=True)
    for c in ("id", "comp", "a", "b"):
        both[c] = both[c].astype("Int64")
    both["w"] = both["w"].astype("Float64")
    return both[["id", "comp", "w", "a", "b"]]


def _first_by(comp: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place of each component's first edge."""
    order = np.lexsort((high, low, weight, comp))
    c = comp[order]
    return order[np.flatnonzero(np.append(True, c[1:] != c[:-1]))]


def _outside(index, vectors, state, doubtful) -> DataFrame | None:
    """Lightest edges out of the doubtful points, as ``(comp, src, dst, w)``."""
    if not doubtful.limit(1).count():
        return None
    traits = state.select("id", "core", "comp")
    # A component without any listed edge has no bound yet: one of its points is
    # searched for first and bounds the rest.
    first = doubtful.where(F.col("bound") == float("inf")).groupBy("comp").agg(
        F.min("id").alias("id")
    )
    first = cut_lineage(first)
    scouts = None
    if first.limit(1).count():
        asking = doubtful.join(first.select("id"), "id").join(vectors, "id")
        scouts = cut_lineage(search(index, asking.withColumnRenamed("id", "qid"), 1, traits=traits))
        bounds = scouts.join(state.select(F.col("id").alias("qid"), "comp"), "qid").select(
            "comp", F.col("w").alias("_scouted")
        )
        doubtful = (
            doubtful.join(bounds, "comp", "left")
            .withColumn("bound", F.least("bound", F.coalesce("_scouted", "bound")))
            .drop("_scouted")
        )
    floors = state.select("id", "floor")
    asking = (
        doubtful.join(floors, "id").where(F.col("floor") <= F.col("bound")).drop("floor").join(vectors, "id")
    )
    found = search(index, asking.withColumnRenamed("id", "qid"), 1, traits=traits)
    if scouts is not None:
        found = found.unionByName(scouts)
    named = found.join(state.select(F.col("id").alias("qid"), "comp"), "qid")
    return cut_lineage(named.select("comp", F.col("qid").alias("src"), F.col("id").alias("dst"), "w"))


def dendrogram(tree: DataFrame, copies: DataFrame, pack_edges: int = PACK_EDGES) -> DataFrame:
    """``(node, w, left, right, left_size, right_size)``: single-linkage merges.

    ``tree`` is ``(w, a, b)``; leaves are point ids, merges have negative names.
    Divide and conquer on edge order: the lighter half of a large set of edges
    falls into components that are independent of each other, and each of them
    is one leaf of the heavier half. Sets that are small enough are merged one
    edge at a time, many sets per task.
    """
    ordered = cut_lineage(
        tree.orderBy("w", "a", "b").withColumn("eid", F.monotonically_increasing_id())
    )
    size_a = copies.select(F.col("id").alias("a"), F.col("copies").alias("size_a"))
    size_b = copies.select(F.col("id").alias("b"), F.col("copies").alias("size_b"))
    work = cut_lineage(
        ordered.join(size_a, "a")
        .join(size_b, "b")
        .select(
            F.lit(-1).cast("bigint").alias("sid"), "eid", "w",
            F.col("a").alias("u"), F.col("b").alias("v"),
            F.col("size_a").alias("u_size"), F.col("size_b").alias("v_size"),
        )
    )
    small: list[DataFrame] = []
    while True:
        sets = work.groupBy("sid").agg(
            F.count(F.lit(1)).alias("_n"), F.percentile_approx("eid", 0.5).alias("_mid"),
            F.max("eid").alias("_max"),
        )
        big = cut_lineage(sets.where(F.col("_n") > pack_edges))
        tagged = work.join(big, "sid", "left")
        small.append(tagged.where(F.col("_n").isNull()).select(*work.columns))
        if not big.limit(1).count():
            break
        # Strictly below the largest edge, so both halves shrink.
        light = (F.col("eid") <= F.col("_mid")) & (F.col("eid") < F.col("_max"))
        split = cut_lineage(tagged.where(F.col("_n").isNotNull()).withColumn("_light", light))
        low = split.where("_light")
        comp = connected(low)
        sized = (
            low.select(F.col("u").alias("node"), F.col("u_size").alias("size"))
            .union(low.select("v", "v_size"))
            .distinct()
            .join(comp, "node")
        )
        tops = low.join(comp.withColumnRenamed("node", "u"), "u").groupBy("comp").agg(
            F.max("eid").alias("_top")
        )
        groups = cut_lineage(
            sized.groupBy("comp").agg(F.sum("size").alias("_size")).join(tops, "comp")
        )
        place = cut_lineage(comp.join(groups, "comp").select("node", "_top", "_size"))
        lower = low.join(place.select(F.col("node").alias("u"), "_top"), "u").select(
            F.col("_top").alias("sid"), "eid", "w", "u", "v", "u_size", "v_size"
        )
        high = split.where(~F.col("_light"))
        for end in ("u", "v"):
            moved = place.select(
                F.col("node").alias(end), F.col("_top").alias("_t"), F.col("_size").alias("_s")
            )
            high = (
                high.join(moved, end, "left")
                .withColumn(f"{end}_size", F.coalesce("_s", f"{end}_size"))
                .withColumn(end, F.coalesce(-F.col("_t") - 1, F.col(end)))
                .drop("_t", "_s")
            )
        upper = high.select(F.col("_max").alias("sid"), "eid", "w", "u", "v", "u_size", "v_size")
        work = cut_lineage(lower.unionByName(upper))
    ready = small[0]
    for part in small[1:]:
        ready = ready.unionByName(part)
    packs = max(1, -(-ordered.count() // pack_edges))

    def merge(edges: pd.DataFrame) -> pd.DataFrame:
        """Join ends edge by edge; sets in one pack share no ends."""
        edges = edges.sort_values("eid", kind="stable")
        parent: dict[int, int] = {}
        node: dict[int, int] = {}
        size: dict[int, int] = {}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for eid, w, u, v, us, vs in zip(
            edges["eid"].tolist(), edges["w"].tolist(), edges["u"].tolist(), edges["v"].tolist(),
            edges["u_size"].tolist(), edges["v_size"].tolist(),
        ):
            for x, s in ((u, us), (v, vs)):
                if x not in parent:
                    parent[x], node[x], size[x] = x, x, s
            a, b = find(u), find(v)
            out.append((-eid - 1, w, node[a], node[b], size[a], size[b]))
            if size[a] < size[b]:
                a, b = b, a
            parent[b] = a
            node[a], size[a] = -eid - 1, size[a] + size[b]
        return pd.DataFrame(out, columns=["node", "w", "left", "right", "left_size", "right_size"])

    return cut_lineage(
        ready.withColumn("_pack", F.pmod(F.xxhash64("sid"), F.lit(packs)))
        .groupBy("_pack")
        .applyInPandas(
            merge,
            "node bigint, w double, left bigint, right bigint, left_size bigint, right_size bigint",
        )
    )


def condense(merges: DataFrame, points: DataFrame, min_cluster_size: int) -> tuple[DataFrame, DataFrame]:
    """Clusters of the hierarchy and the cluster each point falls out of.

    Returns ``(cid, parent, stability)`` and ``(id, cid)``. A merge of two parts
    that both reach the minimum size separates two clusters; a smaller part just
    falls out of the cluster it was attached to.
    """
    mcs = min_cluster_size
    parts = merges.withColumns(
        {
            "lam": F.when(F.col("w") > 0, F.try_divide(F.lit(1.0), F.col("w"))).otherwise(F.lit(float("inf"))),
            "split": (F.col("left_size") >= mcs) & (F.col("right_size") >= mcs),
        }
    )
    sides = F.array(
        F.struct(F.col("left").alias("node"), F.col("left_size").alias("size")),
        F.struct(F.col("right").alias("node"), F.col("right_size").alias("size")),
    )
    child = cut_lineage(
        parts.select(
            F.col("node").alias("parent"), F.col("lam").alias("plam"), F.col("split").alias("psplit"),
            F.inline(sides),
        )
    )
    top = parts.select("node").join(child.select("node"), "node", "left_anti")
    lone = points.select(F.col("id").alias("node")).join(child.select("node"), "node", "left_anti")
    starts_own = (F.col("size") >= mcs) & F.col("psplit")
    pointers = (
        child.select("node", F.when(starts_own, F.col("node")).otherwise(F.col("parent")).alias("ptr"))
        .unionByName(top.union(lone).select("node", F.col("node").alias("ptr")))
    )
    member = cut_lineage(follow(pointers))  # node -> cluster root
    births = child.where(starts_own).select(
        F.col("node").alias("cid"), F.col("plam").alias("birth"), F.col("parent").alias("_via")
    )
    kept = F.when(F.col("split"), F.lit(0)).otherwise(
        F.when(F.col("left_size") >= mcs, F.col("left_size")).otherwise(0)
        + F.when(F.col("right_size") >= mcs, F.col("right_size")).otherwise(0)
    )
    big = parts.where(F.col("left_size") + F.col("right_size") >= mcs)
    leaving = big.select("node", "lam", (F.col("left_size") + F.col("right_size") - kept).alias("gone"))
    # A stack of copies as large as a cluster stays together to the end.
    stacks = points.where(F.col("copies") >= mcs).select(
        F.col("id").alias("node"), F.lit(float("inf")).alias("lam"), F.col("copies").alias("gone")
    )
    falls = leaving.unionByName(stacks).where(F.col("gone") > 0).join(member, "node")
    clusters = (
        falls.join(births.select(F.col("cid").alias("root"), "birth"), "root", "left")
        .groupBy(F.col("root").alias("cid"))
        .agg(
            F.sum(
                # parts that leave where their cluster was born, both at distance 0, add nothing
                F.when(F.col("lam") == F.col("birth"), F.lit(0.0)).otherwise(
                    (F.col("lam") - F.coalesce("birth", F.lit(0.0))) * F.col("gone")
                )
            ).alias("stability")
        )
    )
    parents = births.join(member.select(F.col("node").alias("_via"), F.col("root").alias("parent")), "_via")
    tree = clusters.join(parents.select("cid", "parent"), "cid", "left").select("cid", "parent", "stability")
    placed = points.select(F.col("id").alias("node")).join(member, "node")
    return cut_lineage(tree), placed.select(F.col("node").alias("id"), F.col("root").alias("cid"))


def select_clusters(tree: DataFrame) -> DataFrame:
    """``(cid, chosen)``: the chosen cluster a condensed cluster belongs to, or null.

    Excess of mass: a cluster is kept when it is at least as stable as its
    sub-clusters together; the whole data set never is.
    """
    values = cut_lineage(_values(tree))
    below = values.groupBy(F.col("parent").alias("cid")).agg(F.sum("value").alias("_below"))
    kept = values.join(below, "cid", "left").select(
        "cid", "parent",
        (F.col("parent").isNotNull() & ~(F.coalesce("_below", F.lit(0.0)) > F.col("stability"))).alias("keep"),
    )
    return _topmost(kept)


def _values(tree: DataFrame) -> DataFrame:
    """``(cid, parent, stability, value)``: the greater of a cluster's stability and its children's values.

    Tree contraction: each task first works out what depends on clusters it holds alone. Then, each
    round, values that are known are added to the parents (rake), and where one child is missing, the value is ``max(a, x + b)`` of the value x of a cluster further
    down; such functions of functions have the same form, so a chain's steps double each
    round (compress). Rounds grow with the logarithm of the number of clusters.
    """
    kids = tree.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("cid")).agg(
        F.count(F.lit(1)).alias("open"), F.bit_xor("cid").alias("which")
    )
    unknown = F.lit(None).cast("double")
    state = cut_lineage(
        tree.join(kids, "cid", "left").select(
            "cid", "parent", "stability", F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("which", F.lit(0)).alias("which"),
            F.lit(0.0).alias("known"), F.lit(None).cast("bigint").alias("via"), unknown.alias("a"), unknown.alias("b"),
            unknown.alias("value"), F.lit(False).alias("told"),
        )
    )
    while True:
        state = cut_lineage(state.repartitionByRange("cid").mapInPandas(_settle_here, state.schema))
        if state.where("value IS NULL").isEmpty():
            return state.select("cid", "parent", "stability", "value")
        # settle what depends on something settled
        ahead = state.select(
            F.col("cid").alias("via"), F.col("value").alias("_x"), F.col("via").alias("_via"),
            F.col("a").alias("_a"), F.col("b").alias("_b"),
        )
        done = F.col("value").isNotNull()
        reached = F.when(F.col("_x").isNotNull(), F.greatest("a", F.col("_x") + F.col("b")))
        further = F.col("_x").isNull() & F.col("_via").isNotNull()
        moving = state.where(F.col("via").isNotNull() & ~done).join(ahead, "via", "left").select(
            "cid", "parent", "stability", "open", "which", "known",
            F.when(further, F.col("_via")).otherwise(F.col("via")).alias("via"),
            # one after the other: max(a, max(a', x + b') + b) = max(max(a, a' + b), x + (b' + b))
            F.when(further, F.greatest("a", F.col("_a") + F.col("b"))).otherwise(F.col("a")).alias("a"),
            F.when(further, F.col("_b") + F.col("b")).otherwise(F.col("b")).alias("b"),
            reached.alias("value"), "told",
        )
        resting = state.where(F.col("via").isNull() | done)
        ready = resting.withColumn("value", F.when(~done & (F.col("open") == 0), F.greatest("stability", "known")).otherwise(F.col("value")))
        state = cut_lineage(ready.unionByName(moving))
        # tell parents, and find those that wait for one child only
        news = state.where(F.col("value").isNotNull() & ~F.col("told") & F.col("parent").isNotNull()).groupBy(
            F.col("parent").alias("cid")
        ).agg(F.sum("value").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.bit_xor("cid").alias("_xor"))
        left = F.col("open") - F.coalesce("_n", F.lit(0))
        known = F.col("known") + F.coalesce("_sum", F.lit(0.0))
        which = F.col("which").bitwiseXOR(F.coalesce("_xor", F.lit(0)))
        waits = F.col("value").isNull() & F.col("via").isNull() & (left == 1)
        after = state.join(news, "cid", "left").select(
            "cid", "parent", "stability", left.alias("open"), which.alias("which"), known.alias("known"),
            F.when(waits, which).otherwise(F.col("via")).alias("via"),
            F.when(waits, F.col("stability")).otherwise(F.col("a")).alias("a"),
            F.when(waits, known).otherwise(F.col("b")).alias("b"),
            "value", F.col("value").isNotNull().alias("told"),
        )
        state = cut_lineage(after)


def _settle_here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Values of clusters whose children are settled, from the leaves up as far as parents are in the same task."""
    parts = list(batches)
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    place = {c: i for i, c in enumerate(rows["cid"].tolist())}
    up = [-1 if pd.isna(p) else place.get(int(p), -1) for p in rows["parent"].tolist()]
    cid, stability = rows["cid"].tolist(), rows["stability"].tolist()
    waiting, which, known = rows["open"].tolist(), rows["which"].tolist(), rows["known"].tolist()
    value = [None if pd.isna(v) else v for v in rows["value"].tolist()]
    told = rows["told"].tolist()
    ready = [i for i, v in enumerate(value) if (v is None and waiting[i] == 0) or (v is not None and not told[i])]
    while ready:
        i = ready.pop()
        if value[i] is None:
            value[i] = max(stability[i], known[i])
        above = up[i]
        if above < 0:
            continue
        told[i] = True
        if value[above] is None:
            known[above] += value[i]
            waiting[above] -= 1
            which[above] ^= cid[i]
            if waiting[above] == 0:
                ready.append(above)
    out = rows.assign(open=waiting, which=which, known=known, told=told)
    out["value"] = pd.array([float("nan") if v is None else v for v in value], dtype="float64")
    out["value"] = out["value"].astype("object").where([v is not None for v in value], None)
    yield out


def _topmost(kept: DataFrame) -> DataFrame:
    """``(cid, chosen)``: the topmost kept cluster among a cluster and those above it, by pointer doubling."""
    roots = kept.where(F.col("parent").isNull()).select(F.col("cid").alias("parent"), F.lit(True).alias("_top"))
    state = cut_lineage(
        kept.join(roots, "parent", "left").select(
            "cid", F.when(F.col("_top").isNull(), F.col("parent")).alias("up"), F.when(F.col("keep"), F.col("cid")).alias("chosen")
        )
    )
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select(F.col("cid").alias("up"), F.col("up").alias("_up"), F.col("chosen").alias("_chosen"))
        state = cut_lineage(
            state.join(above, "up", "left").select("cid", F.col("_up").alias("up"), F.coalesce("_chosen", "chosen").alias("chosen"))
        )
    return state.select("cid", "chosen")


def number_labels(found: DataFrame) -> DataFrame:
    """Clusters numbered from 0 by their lowest row id; no cluster is -1."""
    firsts = found.where(F.col("chosen").isNotNull()).groupBy("chosen").agg(F.min("row_id").alias("_first"))
    numbers = rank_in_group(firsts, [], "_first", "cluster").select(
        "chosen", F.col("cluster").cast("int").alias("cluster")
    )
    return found.join(numbers, "chosen", "left").select(
        "row_id", F.coalesce("cluster", F.lit(-1)).alias("cluster")
    )


def density_cluster(
    rows: DataFrame,
    min_cluster_size: int | None = None,
    pivots: int | None = None,
    block_rows: int | None = None,
    pack_edges: int = PACK_EDGES,
) -> DataFrame:
    """``(row_id, cluster)`` from ``(row_id, vec)``; -1 is noise."""
    rows = cut_lineage(rows.select("row_id", F.col("vec").cast("array<double>").alias("vec")))
    mcs = min_cluster_size or default_min_cluster_size(rows.count())
    if mcs < 2:
        raise ValueError("min_cluster_size must be at least 2")
    min_samples = neighbour_count(mcs)
    points = cut_lineage(distinct_points(rows))
    options = {"block_rows": block_rows} if block_rows else {}
    index = build_index(points, pivots=pivots, **options)
    k = max(10, 2 * min_samples)
    neighbours = cut_lineage(knn(points, k, index))
    cores = cut_lineage(core_distances(neighbours, points, min_samples))
    tree = spanning_tree(index, neighbours, cores)
    merges = dendrogram(tree, points, pack_edges)
    clusters, placed = condense(merges, points, mcs)
    chosen = placed.join(select_clusters(clusters), "cid", "left").select("id", "chosen")
    named = points.join(chosen, "id").select("vec", "chosen")
    copies = points.select("vec", F.col("copies").alias("n_rows"))
    return number_labels(join_repeated(rows, named, "vec", copies).select("row_id", "chosen"))
