"""Clustering operators against brute force on small inputs."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from themescope.operators import components, density, linkage
from themescope.operators import kmeans as km
from themescope.operators.density import dendrogram, density_cluster, select_clusters
from themescope.operators.linkage import agglomerative
from themescope.operators.neighbors import build_index, knn, nearest_label, search
from themescope.operators.reduce import pca_reduce, unit_length


def vectors(spark, x):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row_id bigint, vec array<double>")


def labels(df):
    return [r["cluster"] for r in df.orderBy("row_id").collect()]


@pytest.mark.parametrize("options", [{}, {"pivots": 6, "block_rows": 25}])
def test_knn_is_exact(spark, options):
    x = brute.blobs(3, 120, 30)
    far = brute.pairwise(x)
    np.fill_diagonal(far, np.inf)
    points = vectors(spark, x).withColumnRenamed("row_id", "id")
    found = knn(points, 4, build_index(points, **options)).toPandas().sort_values(["qid", "w", "id"])
    want = np.argsort(far, axis=1, kind="stable")[:, :4]
    assert np.array_equal(np.stack(found.groupby("qid")["id"].apply(list).to_list()), want)


def test_search_by_product_is_exact(spark):
    x = brute.blobs(4, 90, 20)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    weight = 1 - x @ x.T
    np.fill_diagonal(weight, np.inf)
    points = vectors(spark, x).withColumnRenamed("row_id", "id")
    index = build_index(points, pivots=5, block_rows=20)
    asked = index.points.select(F.col("id").alias("qid"), "vec")
    found = search(index, asked, 1, metric="dot").toPandas().sort_values("qid")
    assert np.array_equal(found["id"], weight.argmin(1))
    assert np.allclose(found["w"], weight.min(1))


def test_many_queries_on_one_block_are_split(spark, monkeypatch):
    from themescope.operators import neighbors

    monkeypatch.setattr(neighbors, "QUERY_ROWS", 10)
    x = brute.blobs(5, 60, 10)
    points = vectors(spark, x).withColumnRenamed("row_id", "id")
    far = brute.pairwise(x)
    np.fill_diagonal(far, np.inf)
    for options in ({}, {"pivots": 3}):
        found = knn(points, 1, build_index(points, **options)).toPandas().sort_values("qid")
        assert np.array_equal(found["id"], far.argmin(1))


def test_groups_of_a_search_do_not_grow_with_the_table(spark, monkeypatch):
    """A query is shipped once a group: their number must not follow that of the points."""
    from themescope.operators import neighbors

    monkeypatch.setattr(neighbors, "QUERY_ROWS", 10)
    x = np.random.default_rng(8).normal(size=(500, 12))
    far = brute.pairwise(x)
    np.fill_diagonal(far, np.inf)
    points = vectors(spark, x).withColumnRenamed("row_id", "id")
    index = build_index(points, block_rows=5, group_blocks=1)
    assert len(index.block) > 100 and len(np.unique(index.group)) <= 17
    assert index.points.groupBy("group").count().agg(F.max("count")).first()[0] <= 500 / 16 + 5
    found = knn(points, 3, index).toPandas().sort_values(["qid", "w", "id"])
    assert np.array_equal(np.stack(found.groupby("qid")["id"].apply(list).to_list()), np.argsort(far, axis=1, kind="stable")[:, :3])


def stacked(seed):
    """Blobs with copies, one stack of them larger than a cluster."""
    x = brute.blobs(seed, 90, 16)
    return np.vstack([x, x[:9], np.repeat(x[[3]], 14, 0)])


def test_density_matches_sequential(spark):
    for seed in (0, 1):
        x = stacked(seed)
        got = labels(density_cluster(vectors(spark, x), 8))
        assert brute.same_partition(got, brute.density(x, 8, 4))
        assert len(set(got)) > 2


def test_density_in_many_blocks_and_packs(spark):
    """Several blocks and a split tree."""
    x = stacked(2)
    got = labels(
        density_cluster(vectors(spark, x), 8, pivots=4, block_rows=30, pack_edges=40)
    )
    assert brute.same_partition(got, brute.density(x, 8, 4))


def test_density_with_most_points_in_one_component(spark):
    """Nine in ten points in one dense cluster, over many blocks, and small ones far away."""
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(size=(180, 3)) * 0.2, rng.normal(size=(10, 3)) * 0.1 + 6, rng.normal(size=(10, 3)) * 0.1 - 6])
    got = labels(density_cluster(vectors(spark, x), 8, pivots=6, block_rows=20))
    assert brute.same_partition(got, brute.density(x, 8, 4))


@pytest.mark.parametrize("n", [39, 40, 41])
def test_density_is_the_same_around_the_size_of_a_block(spark, n):
    x = brute.blobs(n, n - 6, 6, centres=2)
    got = labels(density_cluster(vectors(spark, x), 6, block_rows=40))
    assert brute.same_partition(got, brute.density(x, 6, 3))


def test_density_all_noise_and_numbering(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(12, 3))
    assert labels(density_cluster(vectors(spark, x), 10)) == [-1] * 12


def test_dendrogram_does_not_depend_on_packs(spark):
    rng = np.random.default_rng(1)
    n = 40
    edges = [(float(rng.integers(1, 9)), int(rng.integers(0, i)), i) for i in range(1, n)]
    tree = spark.createDataFrame(edges, "w double, a bigint, b bigint")
    copies = spark.createDataFrame([(i, 1 + i % 3) for i in range(n)], "id bigint, copies bigint")

    def sizes(pack):
        rows = dendrogram(tree, copies, pack).orderBy(F.desc("node")).collect()
        return [(r["w"], *sorted((r["left_size"], r["right_size"]))) for r in rows]

    assert sizes(1000) == sizes(7)


def walked(rows):
    """Excess of mass from the leaves up, then the topmost kept cluster from the root down."""
    stability, parent = {c: s for c, _, s in rows}, {c: p for c, p, _ in rows}
    children = {}
    for c, p, _ in rows:
        children.setdefault(p, []).append(c)
    order = list(children.get(None, []))
    for c in order:
        order.extend(children.get(c, []))
    value, keep, chosen = {}, {}, {}
    for c in reversed(order):
        below = sum(value[x] for x in children.get(c, []))
        keep[c] = parent[c] is not None and not below > stability[c]
        value[c] = max(below, stability[c])
    for c in order:
        above = chosen.get(parent[c])
        chosen[c] = above if above is not None else c if keep[c] else None
    return chosen


def chosen(spark, rows):
    tree = spark.createDataFrame(rows, "cid bigint, parent bigint, stability double")
    return {r["cid"]: r["chosen"] for r in select_clusters(tree).collect()}


def test_choice_of_clusters_equals_walk(spark, monkeypatch):
    rows = [(0, None, 1.0), (1, 0, 5.0), (2, 0, 1.0), (3, 2, 2.0), (4, 2, 0.5), (5, 1, 2.0), (6, 1, 2.0)]
    assert chosen(spark, rows) == walked(rows) == {0: None, 1: 1, 5: 1, 6: 1, 2: None, 3: 3, 4: 4}
    rng = np.random.default_rng(5)
    for shape in range(3):  # any tree, bushy and deep; whole numbers, so sums are exact
        rows = [(0, None, 3.0), (-7, None, float("inf"))]
        for c in range(1, 80):
            low = 0 if shape == 0 else max(0, c - 3) if shape == 1 else c - 1 - (c % 2)
            rows.append((c, int(rng.integers(low, c)), float(rng.integers(0, 12))))
        assert chosen(spark, rows) == walked(rows)
    # no task holds a parent and its child: rounds alone
    monkeypatch.setattr(density, "_settle_here", lambda batches: batches)
    assert chosen(spark, rows) == walked(rows)


def test_choice_in_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    """20,000 splits one below the other: each leaves a leaf and the rest of the chain."""
    n = 20_000
    rng = np.random.default_rng(6)
    own, leaf = rng.integers(0, 40, n), rng.integers(0, 3, n)
    rows = [(0, None, 0.0)]
    for i in range(n):
        rows += [(2 * i + 1, max(0, 2 * i - 1), float(own[i])), (2 * i + 2, max(0, 2 * i - 1), float(leaf[i]))]
    written = []

    def counted(df, cut=density.cut_lineage):
        written.append(1)
        return cut(df)

    monkeypatch.setattr(density, "cut_lineage", counted)
    assert chosen(spark, rows) == walked(rows)
    assert len(written) < 3 * 40
    written.clear()
    monkeypatch.setattr(density, "_settle_here", lambda batches: batches)  # rounds alone
    assert chosen(spark, rows) == walked(rows)
    assert len(written) < 3 * 40


@pytest.mark.parametrize("alone", [False, True])
def test_pointers_and_components_in_rounds(spark, monkeypatch, alone):
    if alone:  # tasks that work out nothing by themselves
        plain = components._chase
        monkeypatch.setattr(components, "_chase", lambda batches: (x for b in batches for r in range(b.num_rows) for x in plain([b.slice(r, 1)])))
        monkeypatch.setattr(components, "_HELD_NODES", 0)
    chain = spark.createDataFrame([(i, max(0, i - 1)) for i in range(20)] + [(30, 30), (31, 30)], "node bigint, ptr bigint")
    got = {r["node"]: r["root"] for r in components.follow(chain).collect()}
    assert got == {**{i: 0 for i in range(20)}, 30: 30, 31: 30}
    pairs = [(i, i + 2) for i in range(10)] + [(40, 41), (41, 42), (9, 50)]
    edges = spark.createDataFrame(pairs, "u bigint, v bigint")
    expect = {**{i: i % 2 for i in range(12)}, 50: 1, 40: 40, 41: 40, 42: 40}
    assert {r["node"]: r["comp"] for r in components.connected(edges).collect()} == expect


@pytest.mark.parametrize("options", [{}, {"group_rows": 15, "pivots": 2}])
def test_average_linkage_matches_greedy(spark, options):
    x = brute.blobs(6, 40, 12)
    x = np.vstack([x, x[:5]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = labels(agglomerative(vectors(spark, x), 6, **options))
    assert brute.same_partition(got, brute.average_linkage(x, 6), None)


def test_chains_of_merges_take_few_rounds(spark, monkeypatch):
    """Each merge makes the next one possible: 300 vectors on an arc, ever farther apart."""
    angle = np.cumsum(np.linspace(0.001, 0.009, 300))
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    rounds = []

    def counted(*args, build=linkage.build_index, **options):
        rounds.append(1)
        return build(*args, **options)

    monkeypatch.setattr(linkage, "build_index", counted)
    for k in (4, 9):
        got = labels(agglomerative(vectors(spark, x), k, group_rows=100))
        assert brute.same_partition(got, brute.average_linkage(x, k), None)
    assert len(rounds) <= 16


def test_linkage_without_structure_takes_few_rounds(spark, monkeypatch):
    """Few clusters take in the others one after the other, wherever those are filed."""
    x = np.random.default_rng(11).normal(size=(90, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rounds = []

    def counted(*args, build=linkage.build_index, **options):
        rounds.append(1)
        return build(*args, **options)

    monkeypatch.setattr(linkage, "build_index", counted)
    got = labels(agglomerative(vectors(spark, x), 9, group_rows=9))
    assert brute.same_partition(got, brute.average_linkage(x, 9), None)
    assert len(rounds) <= 2


@pytest.mark.parametrize("apart", [1.0, 1e-3, 1e-9])
def test_two_nearest_are_exact_however_close_clusters_are(monkeypatch, apart):
    """Single precision finds them only where it can tell; merged clusters and the asking one do not count."""
    monkeypatch.setattr(linkage, "_ASKS", 16)
    monkeypatch.setattr(linkage, "_TILE_ROWS", 32)
    rng = np.random.default_rng(16)
    mean = np.eye(8)[0] + apart * rng.normal(size=(150, 8))
    mean[40] = mean[7]
    dead = np.where(rng.random(150) < 0.3, np.inf, 0.0)
    dead[[7, 40]] = 0.0
    middle = mean.mean(0)
    side = linkage._side(mean, middle)
    side[dead > 0, -1] = linkage._DEAD
    asks = np.flatnonzero(dead == 0)
    best, w, second = linkage._two_nearest(mean, middle, side, dead, asks)
    far = 1.0 - mean[asks] @ mean.T + dead
    far[np.arange(len(asks)), asks] = np.inf
    assert np.allclose(w, far.min(1), rtol=0, atol=1e-14)
    assert np.allclose(far[np.arange(len(asks)), best], far.min(1), rtol=0, atol=1e-14)
    far[np.arange(len(asks)), best] = np.inf
    assert (second <= far.min(1) + 1e-14).all()
    assert np.allclose(second, far.min(1), rtol=0, atol=1e-3 * apart + 1e-14)
    dead[:] = np.inf
    dead[asks[:1]] = 0.0
    side[:, -1] = np.where(dead > 0, linkage._DEAD, 0.0)
    best, w, second = linkage._two_nearest(mean, middle, side, dead, asks[:1])
    assert best.tolist() == asks[:1].tolist() and np.isinf([w, second]).all()


@pytest.mark.parametrize("apart", [1.0, 1e-3, 1e-8])
@pytest.mark.parametrize("k", [1, 3])
def test_products_find_the_nearest_however_close_points_are(monkeypatch, apart, k):
    from themescope.operators import neighbors

    monkeypatch.setattr(neighbors, "_DOT_CHUNK", 16)
    rng = np.random.default_rng(17)
    x = np.eye(6)[1] + apart * rng.normal(size=(90, 6))
    x[3] = x[50]
    q, weight = x[:60], np.array([1.0 - (v * x).sum(1) for v in x[:60]])
    weight[np.arange(60), np.arange(60)] = np.inf
    want = np.argsort(weight, axis=1, kind="stable")[:, :k]
    ids, zero = np.arange(90), np.zeros(90)
    for bound in (np.full(60, np.inf), np.take_along_axis(weight, want, 1)[:, -1]):
        row, found, w = neighbors._best(q, zero[:60], ids[:60], bound, x, ids, zero, ids, k, "dot")
        assert np.array_equal(found.reshape(60, k), want) and np.array_equal(row, np.repeat(np.arange(60), k))
        assert np.array_equal(w, np.take_along_axis(weight, want, 1).ravel())


@pytest.mark.parametrize("n", [63, 64, 65])
def test_linkage_is_the_same_around_the_size_of_a_group(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = labels(agglomerative(vectors(spark, x), 7, group_rows=64))
    assert brute.same_partition(got, brute.average_linkage(x, 7), None)


def test_zero_vectors_are_set_aside(spark):
    x = np.vstack([np.eye(4), np.zeros((2, 4))])
    got = labels(agglomerative(vectors(spark, x), 2))
    assert got[4:] == [-1, -1] and set(got[:4]) == {0, 1}


def test_kmeans_assigns_nearest_mean(spark):
    x = brute.blobs(7, 120, 0)
    got = np.array(labels(km.kmeans(vectors(spark, x), 4, restarts=4)))
    means = np.array([x[got == c].mean(0) for c in range(4)])
    far = np.sqrt(((x[:, None] - means[None]) ** 2).sum(-1))
    assert np.array_equal(far.argmin(1), got)
    assert brute.same_partition(got.tolist(), [i % 4 for i in range(120)], None)


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8)) * np.arange(1, 9) + 5
    out, explained = pca_reduce(vectors(spark, x), 3)
    got = np.array([r["vec"] for r in out.orderBy("row_id").collect()])
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(centred @ vt[:3].T))
    assert explained == pytest.approx((s[:3] ** 2).sum() / (s**2).sum())
    same, none = pca_reduce(vectors(spark, x), 8)
    assert none is None and np.allclose([r["vec"] for r in same.orderBy("row_id").collect()], x)
    with pytest.raises(ValueError):
        pca_reduce(vectors(spark, x[:3]), 5)


def test_unit_length_keeps_zero(spark):
    out = unit_length(vectors(spark, [[3.0, 4.0], [0.0, 0.0]])).orderBy("row_id").collect()
    assert [r["vec"] for r in out] == [[0.6, 0.8], [0.0, 0.0]]


def test_two_vectors_closer_than_squares_can_tell(spark):
    rows = [(i, [1e-170 * (i % 2), 0.0]) for i in range(4)] + [(4 + i, [5.0 + i, 1.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "row_id bigint, vec array<double>")
    assert density_cluster(df, 2).count() == 8


def test_silhouette_matches_brute_force(spark, monkeypatch):
    x = brute.blobs(8, 60, 0)
    label = [i % 4 for i in range(59)] + [9]
    rows = [(i, [float(v) for v in r], label[i]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id bigint, vec array<double>, cluster int")
    assert km.silhouette(df).first()["silhouette"] == pytest.approx(brute.silhouette(x, label))
    # the number of blocks does not change the result, and no size switches to a sample
    monkeypatch.setattr(km, "BLOCK_ROWS", 17)
    assert km.silhouette(df).first()["silhouette"] == pytest.approx(brute.silhouette(x, label))
    assert km.silhouette(df, sample_rows=20).first()["n"] == 20


def test_blocks_of_a_silhouette_are_small(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(2000, 64))
    label = [i % 3 for i in range(2000)]
    rows = [(i, [float(v) for v in r], label[i]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id bigint, vec array<double>, cluster int")
    kept, write = [], km.cut_lineage
    monkeypatch.setattr(km, "cut_lineage", lambda d: kept.append(write(d)) or kept[-1])
    assert km.silhouette(df).first()["silhouette"] == pytest.approx(brute.silhouette(x, label))
    (blocks,) = [d for d in kept if "x" in d.columns]  # rows that stream past every task, thousands in a batch
    assert blocks.selectExpr("max(octet_length(x))").first()[0] <= 16 * 64 * 8


def test_a_silhouette_passes_over_pairs_it_does_not_need(spark, monkeypatch, tmp_path):
    """Clusters far apart: distances to the own cluster and to the nearest other one, not to all."""
    rng = np.random.default_rng(13)
    x = np.repeat(100.0 * rng.normal(size=(12, 6)), 150, axis=0) + rng.normal(size=(1800, 6))
    label = [i // 150 for i in range(1800)]
    rows = [(i, [float(v) for v in r], label[i]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id bigint, vec array<double>, cluster int")
    seen = str(tmp_path / "pairs")

    def counted(x, y, real=km._exact_distances):
        with open(seen, "a") as file:
            file.write(f"{len(x) * len(y)}\n")
        return real(x, y)

    monkeypatch.setattr(km, "_exact_distances", counted)
    assert km.silhouette(df).first()["silhouette"] == pytest.approx(brute.silhouette(x, label))
    with open(seen) as file:
        assert sum(map(int, file)) < 1800**2 // 2


def test_silhouettes_of_several_labelings_match_brute_force(spark):
    """Pieces of the finest labeling bound the others; a cluster of one row, copies, and a zero vector among them."""
    x = np.vstack([brute.blobs(14, 200, 20), np.zeros((3, 6))])
    x[5] = x[6]
    rng = np.random.default_rng(14)
    far = [np.argmin(brute.pairwise(np.vstack([x, x[rng.choice(len(x), k, False)]]))[: len(x), len(x) :], axis=1) for k in (3, 9, 5)]
    far[0][7] = 40
    rows = [(i, [float(v) for v in r], [int(q[i]) for q in far]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id bigint, vec array<double>, labels array<int>")
    got = {r["labeling"]: r["silhouette"] for r in km._mean_scores(df).collect()}
    assert got == {q: pytest.approx(brute.silhouette(x, far[q].tolist())) for q in range(3)}


def test_a_task_passes_on_the_candidates_that_lead_its_race(spark, monkeypatch):
    x = np.random.default_rng(15).normal(size=(6000, 4))
    rows = vectors(spark, x).coalesce(1)
    raced = []

    def counted(df, *args, real=km.first_in_group):
        raced.append(df.count())
        return real(df, *args)

    monkeypatch.setattr(km, "first_in_group", counted)
    data = km._prepared(rows)
    tasks = data.rdd.getNumPartitions()
    km._seeds(km._grid(data), 5, 2, 42)
    assert max(raced) <= 2 * 10 * tasks
    assert data.columns == ["ids", "x"]  # a pass reads bytes


def test_a_pass_gives_rows_between_centres_to_the_first(spark):
    x = np.array([[0.0, 0.0], [2.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 2.0]])
    grid = km._grid(km._prepared(vectors(spark, x)))
    centres = np.rint(np.array([[0.0, 0.0], [2.0, 0.0], [0.0, 0.0]]) * grid.scale)
    for models in ([centres], [centres[:2], centres[1::-1], centres]):
        for c, (means, some) in zip(models, km._step(grid, models), strict=True):
            near = ((np.rint(x * grid.scale)[:, None] - c[None]) ** 2).sum(2).argmin(1)
            for i in range(len(c)):
                assert some[i] == (near == i).any()
                if some[i]:
                    assert means[i] == pytest.approx(np.rint(np.rint(x * grid.scale)[near == i].mean(0)))


def test_sums_of_a_pass_reach_the_driver_once(spark, monkeypatch):
    x = brute.blobs(9, 400, 0, centres=6)
    rows = vectors(spark, x).repartition(6)
    wanted = {r["k"]: r["inertia"] for r in km.score_ks(rows, 5, 12, restarts=8).collect()}
    frame, sums = type(rows), []
    collect = frame.collect

    def spied(self):
        out = collect(self)
        if "sums" in self.columns:
            sums.append([r["slot"] for r in out])
        return out

    monkeypatch.setattr(km, "_DIRECT", 1000)
    monkeypatch.setattr(frame, "collect", spied)
    got = km.score_ks(rows, 5, 12, restarts=8)
    monkeypatch.undo()
    assert {r["k"]: r["inertia"] for r in got.collect()} == pytest.approx(wanted, rel=1e-12)
    assert sums and all(len(slots) == len(set(slots)) for slots in sums[:3])  # a row a slot, not one from each task


def test_k_search_finds_separated_blobs(spark):
    x = brute.blobs(9, 160, 0, centres=6)
    scores = km.score_ks(vectors(spark, x), 5, 8, restarts=6)
    best = km.choose_k(scores).first()
    assert best["optimal_k"] == 6 and best["method"] == "silhouette"
    once = scores.orderBy("k").collect()
    for tasks in (1, 4, 8):  # the same whatever the partitions
        again = km.score_ks(vectors(spark, x).repartition(tasks), 5, 8, restarts=6).orderBy("k").collect()
        for a, b in zip(once, again, strict=True):
            assert a["k"] == b["k"] and a["inertia"] == pytest.approx(b["inertia"], rel=1e-12)


def test_k_choice_rules(spark):
    flat = [(5, 100.0, 0.1), (6, 40.0, 0.2), (7, 35.0, 0.2), (8, 33.0, 0.05)]
    got = km.choose_k(spark.createDataFrame(flat, "k int, inertia double, silhouette double")).first()
    assert (got["optimal_k"], got["method"], got["best_silhouette_k"]) == (6, "elbow", 6)
    one = km.choose_k(spark.createDataFrame([(5, 1.0, 0.1)], "k int, inertia double, silhouette double"))
    assert one.first()["optimal_k"] == 5


def test_noise_goes_to_nearest_or_stays(spark):
    rows = [(0, [0.0], 3), (1, [10.0], 4), (2, [2.0], -1), (3, [9.0], -1)]
    df = spark.createDataFrame(rows, "row_id bigint, vec array<double>, cluster int")
    assert labels(nearest_label(df)) == [3, 4, 3, 4]
    assert labels(nearest_label(df.where("cluster = -1"))) == [-1, -1]
    assert labels(nearest_label(df.where("cluster <> -1"))) == [3, 4]


def test_groups_hold_cells_that_are_near_each_other(spark):
    rng = np.random.default_rng(11)
    x = np.repeat(100.0 * np.eye(6), 150, axis=0) + rng.normal(size=(900, 6))
    index = build_index(vectors(spark, x).withColumnRenamed("row_id", "id"), pivots=60, block_rows=10)
    met = {(r["id"] // 150, r["group"]) for r in index.points.select("id", "group").collect()}
    groups = len(set(index.group.tolist()))
    assert groups > 4
    assert len(met) <= groups + 5  # a group is shared only where one cluster follows another


@pytest.mark.parametrize("grid", [False, True])
def test_blocks_search_only_for_what_lists_leave_open(spark, monkeypatch, grid):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 8))
    if grid:  # many equal distances
        x = np.array([(a, b) for a in range(17) for b in range(17)], float)
    rows = vectors(spark, x).withColumnRenamed("row_id", "id").withColumn("copies", F.lit(1))
    index = build_index(rows, pivots=8, block_rows=20)
    near = knn(rows, 10, index)
    cores = density.core_distances(near, rows, 2)
    asked = []

    def counted(index, queries, *args, **options):
        asked.append(queries.count())
        return search(index, queries, *args, **options)

    monkeypatch.setattr(density, "search", counted)
    found = sorted((r["w"], r["a"], r["b"]) for r in density.spanning_tree(index, near, cores).collect())
    core = np.array([r["core"] for r in cores.orderBy("id").collect()])
    gap = x[:, None] - x[None]
    w = np.maximum(np.sqrt((gap * gap).sum(2)), np.maximum(core[:, None], core[None]))
    root = list(range(len(x)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    want = []
    for e in sorted((w[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x))):
        i, j = top(e[1]), top(e[2])
        if i != j:
            root[j] = i
            want.append(e)
    assert found == want
    assert all(n < len(x) // 2 for n in asked) or grid
