"""Exact nearest neighbours without an all-pairs join.

Points are filed under their nearest pivot and cut, by distance from it, into blocks of
bounded size; some blocks that follow each other, in an order of pivots that keeps near ones
together, are a group. A query first searches its most
promising group, which gives an upper bound; by the triangle inequality only groups with a block
that could hold something closer are visited after that. Bounds are worked out for pivots
first and only then for the blocks of pivots that remain, a bounded number at a time.

A query's vector is shipped once for each group it visits (8 bytes a dimension), a group's
points once for each part of the queries that visit it. Groups and parts grow with the table, so
that there are about GROUPS of each and what is shuffled is in proportion to the points even where
no group can be ruled out; beyond MAX_GROUP_ROWS rows their number grows instead. Within a
group its blocks are searched in turn, with a bound that tightens. Kernels return at most k rows
per query, so the pairs themselves are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.operators.rows import first_in_group, seeded_hash
from themescope.session import cut_lineage

BLOCK_ROWS = 2048
GROUP_BLOCKS = 16
QUERY_ROWS = 8192
# Groups of points, and parts of the queries, that a large table is cut into, as long as each fits a task.
GROUPS = 16
MAX_GROUP_ROWS = 65_536
MAX_PIVOTS = 1024
# The block list is held by every task; blocks grow beyond this many.
MAX_BLOCKS = 100_000
_CHUNK = 512
_DOT_CHUNK = 256
# Points of a group that are weighed at once, and queries that go through a group together.
_TILE_ROWS = 2048
_ASK_ROWS = 8192
# Queries whose bounds to all pivots are worked out at once, and bounds to blocks at once.
_ROUTE_ROWS = 512
_ROUTE_CELLS = 1_000_000
_MATCH = "qid bigint, id bigint, w double"


@dataclass
class Index:
    """Points filed in blocks, and what a query needs to choose among them."""

    points: DataFrame  # id, vec, block, group
    pivots: np.ndarray  # at most MAX_PIVOTS rows
    block: np.ndarray  # block numbers, by cell
    cell: np.ndarray  # pivot of each block
    group: np.ndarray  # group of each block
    inner: np.ndarray  # smallest and largest distance from that pivot
    outer: np.ndarray
    size: np.ndarray
    block_rows: int


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal-length vectors as a 2-D array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


def build_index(
    points: DataFrame, pivots: int | None = None, block_rows: int | None = None, group_blocks: int = GROUP_BLOCKS
) -> Index:
    """File ``(id, vec)`` points. ``vec`` is an array of doubles of one width."""
    spark = points.sparkSession
    points = points.select("id", F.col("vec").cast("array<double>").alias("vec"))
    total = points.count()
    block_rows = max(block_rows or BLOCK_ROWS, -(-total // MAX_BLOCKS))
    wanted = pivots or min(MAX_PIVOTS, max(1, total // (block_rows // 2 or 1)))
    # the rows of least hash; each task passes on as many
    chosen = points.orderBy(seeded_hash(F.col("id"), 42)).limit(wanted).collect()
    centre = _near_together(np.array([r["vec"] for r in chosen], dtype=np.float64))
    shared = spark.sparkContext.broadcast(centre)

    def file_under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(matrix(batch.column("vec")), shared.value) if batch.num_rows else np.zeros((0, 1))
            nearest = far.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("vec"),
                    pa.array(nearest.astype(np.int32)),
                    pa.array(far[np.arange(len(far)), nearest]),
                ],
                names=["id", "vec", "cell", "radius"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell and radius; each block has rows of one cell."""
        task = TaskContext.get().partitionId() << 32
        last, rows, block = None, 0, -1
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            number = np.empty(len(cell), np.int64)
            for at in range(0, len(cell)):
                if cell[at] != last or rows == block_rows:
                    last, rows, block = cell[at], 0, block + 1
                number[at], rows = block, rows + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(task + number)], names=[*batch.schema.names, "block"])

    filed = cut_lineage(points.mapInArrow(file_under, "id bigint, vec array<double>, cell int, radius double"))
    order = ("cell", "radius", "id")  # a cell, or a radius, with most points is split by the next key
    dealt = filed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(dealt.mapInArrow(cut, "id bigint, vec array<double>, cell int, radius double, block bigint"))
    table = (
        placed.groupBy("block")
        .agg(
            F.first("cell").alias("cell"),
            F.min("radius").alias("inner"),
            F.max("radius").alias("outer"),
            F.count(F.lit(1)).alias("n"),
        )
        .collect()  # one line per block, at most about MAX_BLOCKS and one for each pivot and task
    )
    table.sort(key=lambda r: (r["cell"], r["block"]))
    group = _grouped([r["n"] for r in table], group_blocks, min(MAX_GROUP_ROWS, total / GROUPS))
    named = [(r["block"], g) for r, g in zip(table, group, strict=True)]
    groups = spark.createDataFrame(named or [(None, None)], "block bigint, group bigint")
    return Index(
        placed.join(F.broadcast(groups), "block").select("id", "vec", "block", "group"),
        centre,
        np.array([r["block"] for r in table], dtype=np.int64),
        np.array([r["cell"] for r in table], dtype=np.int64),
        np.array(group, dtype=np.int64),
        np.array([r["inner"] for r in table]),
        np.array([r["outer"] for r in table]),
        np.array([r["n"] for r in table], dtype=np.int64),
        block_rows,
    )


def _near_together(pivots: np.ndarray) -> np.ndarray:
    """Pivots in an order that keeps near ones together: each is followed by the nearest of those left."""
    far, order, at = distances(pivots, pivots), [], 0
    for _ in range(len(pivots)):
        order.append(at)
        far[:, at] = np.inf
        at = int(far[at].argmin())
    return pivots[order]


def _grouped(sizes: list[int], blocks: int, rows: float) -> list[int]:
    """Groups of blocks that follow each other, each of so many blocks and rows at least."""
    out, group, held, many = [], 0, 0, 0
    for size in sizes:
        if held >= blocks and many >= rows:
            group, held, many = group + 1, 0, 0
        out.append(group)
        held, many = held + 1, many + size
    return out


def _low(metric, far, length, core, inner, outer):
    """Least possible weight between queries at ``far`` from a pivot and points filed at inner to outer."""
    if metric == "dot":  # here ``far`` is the product with the pivot
        return 1.0 - far - length * outer - 1e-9
    low = np.maximum(np.maximum(far - outer, inner - far), 0.0)
    return np.maximum(low - 1e-7 * (1.0 + far), core)


def _reach(q: np.ndarray, pivots: np.ndarray, metric: str):
    """Distance (or product) of queries to pivots, and the queries' lengths."""
    return (q @ pivots.T if metric == "dot" else distances(q, pivots)), np.sqrt((q * q).sum(1))


class Router:
    """Which groups a query must visit: bounds to cells first, then to blocks of cells that remain."""

    def __init__(self, at: dict, metric: str):
        self.at, self.metric = at, metric
        cell = at["cell"]
        self.cells, self.first = np.unique(cell, return_index=True)
        self.many = np.diff(np.append(self.first, len(cell)))
        self.inner = np.minimum.reduceat(at["inner"], self.first) if len(cell) else at["inner"]
        self.outer = np.maximum.reduceat(at["outer"], self.first) if len(cell) else at["outer"]

    def _blocks(self, far, length, core, comp, row, cell):
        """(row, block, bound) for all blocks of the given cells, in parts of bounded size."""
        at, edge = self.at, np.cumsum(self.many[cell])
        part = np.append(0, np.flatnonzero(np.diff(edge // _ROUTE_CELLS)) + 1).tolist() if len(row) else []
        for a, b in zip(part, [*part[1:], len(row)], strict=True):
            many = self.many[cell[a:b]]
            r = np.repeat(row[a:b], many)
            start = np.repeat(self.first[cell[a:b]] - np.cumsum(many) + many, many)
            block = start + np.arange(len(r))
            low = _low(
                self.metric, far[r, np.repeat(cell[a:b], many)], length[r], core[r], at["inner"][block], at["outer"][block]
            )
            if at["pure"] is not None:
                low[comp[r] == at["pure"][block]] = np.inf
            yield r, block, low

    def _bounds(self, vec, core):
        far, length = _reach(vec, self.at["pivots"][self.cells], self.metric)
        return far, length, _low(self.metric, far, length[:, None], core[:, None], self.inner, self.outer)

    def home(self, vec, core, comp) -> np.ndarray:
        """The group of each query's most promising block among its nearest cells; -1 if none is open."""
        far, length, low = self._bounds(vec, core)
        out = np.full(len(vec), -1, np.int64)
        order = np.argsort(low, axis=1, kind="stable")
        todo, depth, step = np.arange(len(vec)), 0, 4
        while len(todo) and depth < order.shape[1]:
            cell = order[todo, depth : depth + step]
            best = np.full(len(vec), np.inf)
            at = np.zeros(len(vec), np.int64)
            rows = np.repeat(todo, cell.shape[1])
            for r, block, bound in self._blocks(far, length, core, comp, rows, cell.ravel()):
                order_ = np.lexsort((bound, r))
                r, block, bound = r[order_], block[order_], bound[order_]
                first = np.append(True, np.diff(r) > 0) if len(r) else np.zeros(0, bool)
                r, block, bound = r[first], block[first], bound[first]
                better = bound < best[r]
                best[r[better]], at[r[better]] = bound[better], block[better]
            found = todo[np.isfinite(best[todo])]
            out[found] = self.at["group"][at[found]]
            todo, depth, step = todo[~np.isfinite(best[todo])], depth + step, step * 4
        return out

    def reachable(self, vec, core, comp, limit) -> tuple[np.ndarray, np.ndarray]:
        """(row, group) pairs, each once."""
        far, length, low = self._bounds(vec, core)
        row, cell = np.nonzero(low <= limit[:, None])
        names, number = np.unique(self.at["group"], return_inverse=True)
        hit = np.zeros((len(vec), len(names)), bool)
        for r, block, bound in self._blocks(far, length, core, comp, row, cell):
            good = (bound <= limit[r]) & np.isfinite(bound)
            hit[r[good], number[block[good]]] = True
        row, at = np.nonzero(hit)
        return row, names[at]


def _best(q, core, comp, bound, x, xid, xcore, xcomp, k, metric):
    """Up to k lightest partners per query within its bound, from one tile: (row, id, w)."""
    hits = []
    xx = (x * x).sum(1)
    if metric == "dot":  # what points differ by from their middle, in single precision; few pairs are left to be weighed in full
        middle = x.mean(0) if len(x) else x.sum(0)
        side = (middle - x).astype(np.float32)
        reach = np.sqrt(((x - middle) ** 2).sum(1).max(initial=0.0))
    else:  # one product gives the squared distance less the query's own square
        side = np.column_stack([x * -2.0, xx])
    chunk = _DOT_CHUNK if metric == "dot" else _CHUNK
    for at in range(0, len(q), chunk):
        part = slice(at, at + chunk)
        a, a_core, a_bound = q[part], core[part], bound[part]
        if metric == "dot":
            rough = a.astype(np.float32) @ side.T
            base = 1.0 - a @ middle
            length = np.sqrt((a * a).sum(1).max(initial=0.0))
            # rounding of the products, and of bases and limits where they are added or compared
            slack = 2.0**-24 * (2 * (a.shape[1] + 4) * length * reach + 4 * (2.0 + np.abs(base).max(initial=0.0))) + 1e-10
            limit = a_bound
        else:
            rough = np.column_stack([a, np.ones(len(a))]) @ side.T
            base = (a * a).sum(1)
            slack = 1e-11 * (base.max() + xx.max() if len(x) else 0.0)
            limit = a_bound**2
        near = rough <= (limit + 2 * slack - base).astype(rough.dtype)[:, None]
        if np.count_nonzero(near) <= 8 * k * len(a):  # bounds of other tiles leave little to weigh
            row, col = np.divmod(np.flatnonzero(near), near.shape[1])
            other = comp[part][row] != xcomp[col]
            row, col = row[other], col[other]
        else:
            rough += base.astype(rough.dtype)[:, None]
            if metric != "dot":
                rough = np.maximum(rough, np.maximum(a_core[:, None], xcore[None, :]) ** 2)
            rough[comp[part][:, None] == xcomp[None, :]] = np.inf
            if k < rough.shape[1]:
                limit = np.minimum(limit, rough.min(1) if k == 1 else np.partition(rough, k - 1, axis=1)[:, k - 1])
            few = (rough <= (limit + 2 * slack).astype(rough.dtype)[:, None]) & np.isfinite(rough)
            row, col = np.divmod(np.flatnonzero(few), few.shape[1])
        # Products of norms lose digits for near points: weigh the few left directly.
        if metric == "dot":
            w = 1.0 - (a[row] * x[col]).sum(1)
        else:
            gap = a[row] - x[col]
            w = np.sqrt((gap * gap).sum(1))
            w = np.maximum(w, np.maximum(a_core[row], xcore[col]))
        keep = w <= a_bound[row]
        row, col, w = row[keep], col[keep], w[keep]
        order = np.lexsort((xid[col], w, row))
        row, col, w = row[order], col[order], w[order]
        starts = np.searchsorted(row, row)  # first position of each query's run
        first = np.arange(len(row)) - starts < k
        hits.append((row[first] + at, xid[col[first]], w[first]))
    if not hits:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*hits))


def _best_in_group(query: dict, point: dict, at: dict, k: int, metric: str):
    """Up to k lightest partners per query in a group: (qid, id, w)."""
    order = np.argsort(point["block"], kind="stable")
    point = {c: v[order] for c, v in point.items()}
    names, first = np.unique(point["block"], return_index=True)
    spans = dict(zip(names.tolist(), zip(first, [*first[1:], len(order)], strict=True), strict=True))
    mine = np.flatnonzero(np.isin(at["block"], names))
    found = []
    for start in range(0, len(query["qid"]), _ASK_ROWS):
        part = {c: v[start : start + _ASK_ROWS] for c, v in query.items()}
        found.append(_best_of_blocks(part, point, spans, mine, at, k, metric))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _tiles(order: list[int], size: list[int]) -> Iterator[list[int]]:
    """Blocks in order, as many together as have _TILE_ROWS rows at most."""
    held, many = [], 0
    for j in order:
        if held and many + size[j] > _TILE_ROWS:
            yield held
            held, many = [], 0
        held.append(j)
        many += size[j]
    if held:
        yield held


def _best_of_blocks(query: dict, point: dict, spans: dict, mine: np.ndarray, at: dict, k: int, metric: str):
    n = len(query["qid"])
    best_w, best_id = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
    far, length = _reach(query["vec"], at["pivots"][at["cell"][mine]], metric)
    low = _low(metric, far, length[:, None], query["core"][:, None], at["inner"][mine], at["outer"][mine])
    span = [spans[b] for b in at["block"][mine].tolist()]
    # the blocks that are likely to bound most queries go first
    for tile in _tiles(np.argsort(low.sum(0), kind="stable").tolist(), [b - a for a, b in span]):
        limit = np.minimum(query["bound"], best_w[:, -1])
        asks = np.flatnonzero(low[:, tile].min(1) <= limit)
        if not len(asks):
            continue
        part = np.concatenate([np.arange(*span[j]) for j in tile])
        row, found, w = _best(
            *(query[c][asks] for c in ("vec", "core", "comp")), limit[asks],
            *(point[c][part] for c in ("vec", "id", "core", "comp")), k, metric,
        )
        if not len(row):
            continue
        place = np.arange(len(row)) - np.searchsorted(row, row)
        some, line = np.unique(row, return_inverse=True)
        more_w = np.full((len(some), k), np.inf)
        more_id = np.full((len(some), k), np.iinfo(np.int64).max)
        more_w[line, place], more_id[line, place] = w, found
        some = asks[some]
        w, found = np.hstack([best_w[some], more_w]), np.hstack([best_id[some], more_id])
        by = np.lexsort((found, w), axis=1)[:, :k]
        line = np.arange(len(some))[:, None]
        best_w[some], best_id[some] = w[line, by], found[line, by]
    row, col = np.nonzero(np.isfinite(best_w))
    return query["qid"][row], best_id[row, col], best_w[row, col]


def search(
    index: Index,
    queries: DataFrame,
    k: int,
    metric: str = "euclid",
    traits: DataFrame | None = None,
) -> DataFrame:
    """``(qid, id, w)``: the k lightest partners of each query, ties to the lower id.

    ``queries``: qid, vec and optionally core, comp, bound. ``traits``: id, core,
    comp of the points. The weight is the distance, or with cores the greatest
    of both cores and the distance (``metric="dot"``: one minus the product).
    Points of a query's own comp are not partners; with no comps given, that is
    the point with the query's own id. Partners beyond ``bound`` do not count.
    """
    names = queries.columns
    q = queries.select(
        "qid",
        F.col("vec").cast("array<double>").alias("vec"),
        (F.col("core") if "core" in names else F.lit(0.0)).alias("core"),
        (F.col("comp") if "comp" in names else F.col("qid")).cast("bigint").alias("comp"),
        (F.col("bound") if "bound" in names else F.lit(float("inf"))).alias("bound"),
    )
    points = index.points
    if traits is None:
        points = points.select("block", "group", "id", "vec", F.lit(0.0).alias("core"), F.col("id").alias("comp"))
    else:
        points = points.join(traits.select("id", "core", "comp"), "id").select(
            "block", "group", "id", "vec", "core", F.col("comp").cast("bigint").alias("comp")
        )
    pure = None if traits is None else _pure_blocks(index, points)
    state = {
        "pivots": index.pivots, "block": index.block, "cell": index.cell, "group": index.group,
        "inner": index.inner, "outer": index.outer, "pure": pure,
    }
    shared = q.sparkSession.sparkContext.broadcast(state)
    routed = cut_lineage(_routed(q.withColumn("home", F.lit(None).cast("bigint")), shared, metric))
    part_rows = int(index.size.sum()) // GROUPS
    home = _match(routed, points, shared, k, metric, part_rows)
    if len(np.unique(index.group)) < 2:
        return home
    home = cut_lineage(home)
    reach = home.groupBy("qid").agg(F.count(F.lit(1)).alias("_hits"), F.max("w").alias("_kth"))
    tighter = (
        routed.withColumn("home", F.col("groups")[0])
        .join(reach, "qid", "left")
        .withColumn("bound", F.when(F.col("_hits") >= k, F.least("bound", "_kth")).otherwise(F.col("bound")))
        .select(*q.columns, "home")
    )
    rest = cut_lineage(_routed(tighter, shared, metric))
    return _keep_best(home.unionByName(_match(rest, points, shared, k, metric, part_rows)), k)


def _keep_best(found: DataFrame, k: int) -> DataFrame:
    return first_in_group(found, ["qid"], [F.asc("w"), F.asc("id")], k, "place").drop("place")


def _pure_blocks(index: Index, points: DataFrame) -> np.ndarray:
    """The one comp a block holds, or a value no comp has when it holds several."""
    rows = points.groupBy("block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).collect()
    single = {r["block"]: r["lo"] for r in rows if r["lo"] == r["hi"]}
    none = np.iinfo(np.int64).min
    return np.array([single.get(b, none) for b in index.block.tolist()], dtype=np.int64)


def _routed(q: DataFrame, shared, metric: str) -> DataFrame:
    """Queries with the groups they visit: the home group, or with a ``home`` all others in reach."""

    def route(batches):
        router = Router(shared.value, metric)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROUTE_ROWS):
                part = batch.slice(at, _ROUTE_ROWS)
                vec = matrix(part.column("vec"))
                core, comp, bound = (part.column(c).to_numpy(zero_copy_only=False) for c in ("core", "comp", "bound"))
                groups: list[list[int]] = [[] for _ in range(len(vec))]
                if part.column("home").null_count:
                    for row, group in enumerate(router.home(vec, core, comp).tolist()):
                        groups[row] = [group] if group >= 0 else []
                else:
                    home = part.column("home").to_numpy()
                    row, group = router.reachable(vec, core, comp, bound)
                    keep = group != home[row]
                    for r, g in zip(row[keep].tolist(), group[keep].tolist(), strict=True):
                        groups[r].append(g)
                some = pa.array([bool(g) for g in groups])
                arrays = [*part.columns[:5], pa.array(groups, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[:5], "groups"]).filter(some)

    return q.mapInArrow(
        route, "qid bigint, vec array<double>, core double, comp bigint, bound double, groups array<bigint>"
    )


def _match(routed: DataFrame, points: DataFrame, shared, k: int, metric: str, part_rows: int) -> DataFrame:
    """Best partners of every query among the points of the groups it visits.

    A group that many queries visit is copied, so that no task gets more of them than about
    ``part_rows`` (QUERY_ROWS at least, MAX_GROUP_ROWS at most).
    """
    visits = routed.select(F.explode("groups").alias("group")).groupBy("group").count().collect()  # a line a group
    held = max(QUERY_ROWS, min(MAX_GROUP_ROWS, part_rows))
    many = [(r["group"], -(-r["count"] // held)) for r in visits if r["count"] > held]
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    table = routed.sparkSession.createDataFrame(many or [(None, 1)], "group bigint, _copies int")
    asking = routed.select("qid", "vec", "core", "comp", "bound", F.explode("groups").alias("group"))
    asking = asking.join(table, "group", "left").withColumn("copy", F.pmod(F.xxhash64("qid"), copies).cast("int"))
    # groups that nobody visits find no partner in the cogroup; their points stay in one copy
    holding = points.join(table, "group", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        def columns(table: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
            out = {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in names}
            return out | {"vec": matrix(table.column("vec"))}

        if left.num_rows == 0 or right.num_rows == 0:
            qid, xid, w = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            query = columns(left, ("qid", "core", "comp", "bound"))
            point = columns(right, ("id", "core", "comp", "block"))
            qid, xid, w = _best_in_group(query, point, shared.value, k, metric)
        return pa.table({"qid": qid, "id": xid, "w": w})

    return (
        asking.select("group", "copy", "qid", "vec", "core", "comp", "bound")
        .groupBy("group", "copy")
        .cogroup(
            holding.select("group", "copy", "id", "vec", "core", "comp", "block").groupBy("group", "copy")
        )
        .applyInArrow(kernel, _MATCH)
    )


def knn(points: DataFrame, k: int, index: Index | None = None) -> DataFrame:
    """``(qid, id, w)``: the k nearest other points of each point."""
    index = index or build_index(points)
    return search(index, index.points.select(F.col("id").alias("qid"), "vec"), k)


def nearest_label(rows: DataFrame, block_rows: int | None = None, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """Give noise rows (cluster -1) the cluster of their nearest non-noise row.

    ``rows`` has row_id, vec, cluster. Nothing changes when there is no noise or
    nothing else. Ties go to the lower row id.
    """
    noise = rows.where(F.col("cluster") == -1)
    known = rows.where(F.col("cluster") != -1)
    if not noise.limit(1).count() or not known.limit(1).count():
        return rows.select("row_id", "cluster")
    index = build_index(known.select(F.col("row_id").alias("id"), "vec"), block_rows=block_rows, group_blocks=group_blocks)
    found = search(index, noise.select(F.col("row_id").alias("qid"), "vec"), 1)
    labels = known.select(F.col("row_id").alias("id"), F.col("cluster").alias("_given"))
    given = found.join(labels, "id").select(F.col("qid").alias("row_id"), "_given")
    return rows.select("row_id", "cluster").join(given, "row_id", "left").select(
        "row_id", F.coalesce("_given", "cluster").alias("cluster")
    )
