"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words (letters and digits, lower case); a text of fewer words is one
shingle. Its weight is ``tf * sqrt(idf)``, with document frequencies counted over the whole
corpus in ``2**BITS`` hashed buckets, rounded to steps of ``GRAIN`` in the logarithm. A bucket
counts all its shingles, so a rare shingle's frequency is never taken below the bucket's average load:
with s different shingles a text, s / 2**BITS of all texts (0.2 % at 500).

1. *Counts.* Each task adds up its own bucket counts; the sums make a table of fixed size
   (``2**BITS`` small numbers), the only thing that is broadcast.
2. *Samples.* ``BANDS * ROWS`` consistent weighted samples a text: for sample k a shingle of
   weight w has ``t = floor(ln w / r + b)`` and value ``ln c - r (t - b + 1)``; the least
   value wins and (shingle, t) is the sample. r, c (Gamma(2, 1)) and b (uniform) are drawn
   for ``ENTRIES`` hash values of a shingle. Samples of two texts agree with the probability
   of their weighted Jaccard similarity; texts that agree on a whole band are candidates.
   As many samples again are drawn with all weights equal, which agree with the probability of
   the plain Jaccard similarity. Both halves of the link test thus have ``BANDS`` bands of
   their own: a pair at 0.8 of either shares none of that half's 16 in 1 of 97,000 cases.
3. *Stars.* Texts with the same shingles are one node from here on. A bucket's centre is the node
   that meets most others in all its buckets. In a round each node is compared with one centre, the
   one that most of its buckets have, unless they share a class; the next round takes other
   centres. Linked groups, however large, take one comparison a node and round.
4. *Rest.* Where a bucket still holds several classes, the nodes outside its largest class
   are compared with the others, block against block, so a task holds two blocks of
   ``BLOCK`` nodes and no pair is written that is no link.
5. *Classes* are the connected components of the links.

A link needs a weighted or a plain Jaccard similarity of ``LEAST`` or more, computed exactly.
Work outside linked groups grows with the pairs of near but unlinked texts in a bucket.

Defined results: null texts and texts without a word belong to nobody (class: their own id);
rows that repeat, with the same id or not, share a class; a class is named by its least
id (null if it has none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.llm.common import raw_texts, slices, text_key
from themescope.llm.license import _WORDS
from themescope.llm.rolling import BASE, Prefix, mix
from themescope.session import cut_lineage, release

SHINGLE = 5
LEAST = 0.8
BANDS = 16
ROWS = 3
BITS = 18
GRAIN = 0.25
LEVELS = 48
ENTRIES = 1 << 15
STARS = 4
BLOCK = 200


def shingles(texts: list[bytes]):
    """Different shingles of each text with their counts: (hash, count, text), by text and hash."""
    data = np.frombuffer((b" ".join([*texts, b""])).translate(_WORDS), np.uint8)
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    stops = np.cumsum(sizes)
    inside = np.concatenate([[False], data != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    of = np.searchsorted(stops, starts, "right")
    word = Prefix(data).of(starts, ends)
    n = np.bincount(of, minlength=len(texts))
    k = SHINGLE
    h = np.zeros(max(0, len(word) - k + 1), np.uint64)
    for j in range(k):
        h = h * BASE + word[j : j + len(h)]
    whole = of[: len(h)] == of[k - 1 :] if len(h) else np.zeros(0, bool)
    h, at = mix(h[whole]), of[: len(h)][whole]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        first = np.cumsum(n) - n
        short = []
        for t in few:
            x = int(n[t])
            for w in word[first[t] : first[t] + n[t]].tolist():
                x = (x * int(BASE) + w) % 2**64
            short.append(x)
        h, at = np.concatenate([h, mix(np.array(short, np.uint64))]), np.concatenate([at, few])
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (at[1:] != at[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[new], np.diff(np.append(new, len(h))), at[new]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def idf_levels(docs: DataFrame) -> np.ndarray:
    """ln sqrt(idf) of each hashed bucket, in steps of GRAIN."""

    def count(batches):
        df, total = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                texts = raw_texts(part.column(0))
                h, _, _ = shingles(texts)
                df += np.bincount(_bucket(h), minlength=1 << BITS)
                total += len(texts)
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(k, -1).astype(np.int32)), pa.array(np.append(df[k], total))], names=["k", "n"]
        )

    sums = docs.select("text").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    table = cut_lineage(sums).toArrow()  # at most 2**BITS rows
    k, n = table.column(0).to_numpy(), table.column(1).to_numpy()
    df = np.zeros(1 << BITS)
    df[k[k >= 0]] = n[k >= 0]
    total = int(n[k < 0].sum())
    idf = 1 + np.log((total + 1) / (np.minimum(df, total) + 1))
    return np.rint(0.5 * np.log(idf) / GRAIN).astype(np.int8)


def _levels(h: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithm of the weight in steps of GRAIN."""
    return np.minimum(idf[_bucket(h)] + np.rint(np.log(count) / GRAIN).astype(np.int64), LEVELS - 1)


def weight(level: np.ndarray) -> np.ndarray:
    return np.exp(level * GRAIN)


class Sampler:
    """Tables of values and of t for each weight level and hash entry."""

    def __init__(self):
        draw = np.random.default_rng(11)
        r, c = draw.gamma(2, 1, ENTRIES), draw.gamma(2, 1, ENTRIES)
        b = draw.uniform(0, 1, ENTRIES)
        levels = np.arange(LEVELS)[:, None] * GRAIN
        t = np.floor(levels / r + b)
        value = (np.log(c) - r * (t - b + 1)).astype(np.float32)
        bits = value.view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))  # sorts as the values do
        self.value = bits.astype(np.uint64).ravel() << np.uint64(32)
        self.t = t.astype(np.int64).ravel()
        seeds = draw.integers(1, 2**63, 2 * BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.seeds, self.plain_seeds = seeds[: BANDS * ROWS], seeds[BANDS * ROWS :]

    def all_bands(self, h: np.ndarray, level: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Weighted bands, then as many with all weights equal."""
        return np.hstack([self.bands(h, level, first), self.bands(h, np.zeros_like(level), first, self.plain_seeds)])

    def bands(self, h: np.ndarray, level: np.ndarray, first: np.ndarray, seeds: np.ndarray | None = None) -> np.ndarray:
        """One hash for each text (shingles from ``first`` on) and band."""
        place = np.arange(len(h), dtype=np.uint64)
        offset = level.astype(np.int64) * ENTRIES
        shift = np.uint64(64 - (ENTRIES.bit_length() - 1))
        out = np.zeros((len(first), BANDS), np.uint64)
        for k, seed in enumerate(self.seeds if seeds is None else seeds):
            entry = offset + ((h * seed) >> shift).astype(np.int64)
            least = np.minimum.reduceat(self.value[entry] | place, first)
            at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            sample = mix(h[at] + self.t[entry[at]].astype(np.uint64) * BASE + np.uint64(k))
            out[:, k // ROWS] = mix(out[:, k // ROWS] * BASE + sample)
        return out


def _sets(texts: list[bytes], idf: np.ndarray):
    h, count, of = shingles(texts)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    return h, count, of, first, _levels(h, count, idf)


def signatures(docs: DataFrame, idf) -> DataFrame:
    """``(doc_id, d1, d2, node, bands)``; node stands for the shingles of a text (null without words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        sampler = Sampler()
        for batch in batches:
            for part in slices(batch):
                texts = raw_texts(part.column(3))
                h, count, of, first, level = _sets(texts, idf.value)
                node = np.zeros(len(texts), np.uint64)
                some = of[first]
                bands: list = [None] * len(texts)
                if len(first):
                    node[some] = mix(np.add.reduceat(mix(h + count.astype(np.uint64) * BASE), first))
                    for t, row in zip(some.tolist(), sampler.all_bands(h, level, first).view(np.int64), strict=True):
                        bands[t] = row
                empty = np.ones(len(texts), bool)
                empty[some] = False
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), part.column(2),
                        pa.array(node.view(np.int64), mask=empty), pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "d1", "d2", "node", "bands"],
                )

    rows = docs.select("doc_id", *text_key(), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, d1 long, d2 long, node long, bands array<long>")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, idf) -> DataFrame:
    """``(node, ids, levels)`` as binaries; ``wanted``: (key, d1, d2, node)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                h, _, of, first, level = _sets(raw_texts(part.column(1)), idf.value)
                ends = np.append(first[1:], len(h))
                cut = list(zip(first.tolist(), ends.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(of[first])),
                        pa.array([_short(h[a:b]) for a, b in cut], pa.binary()),
                        pa.array([level[a:b].astype(np.int8).tobytes() for a, b in cut], pa.binary()),
                    ],
                    names=["node", "ids", "levels"],
                )

    rows = docs.select("text", *text_key(), _key(docs))
    # a row that repeats as a whole counts once; the join has dealt rows by these columns already
    texts = rows.join(wanted, ["key", "d1", "d2"]).dropDuplicates(["key", "d1", "d2"]).select("node", "text")
    return texts.mapInArrow(run, "node long, ids binary, levels binary")


def similar(a: tuple, b: tuple) -> float:
    """Larger of the weighted and the plain Jaccard similarity of two (ids, levels)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    x, y = weight(a[1].astype(float)), weight(b[1].astype(float))
    shared = np.minimum(x[i], y[j]).sum()
    return max(shared / (x.sum() + y.sum() - shared), len(i) / (len(a[0]) + len(b[0]) - len(i)))


def _short(h: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, which keep their order."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _set(ids: bytes, levels: bytes) -> tuple:
    long = np.zeros((len(ids) // 6, 8), np.uint8)
    long[:, 2:] = np.frombuffer(ids, np.uint8).reshape(-1, 6)
    return long.view(np.uint64).ravel(), np.frombuffer(levels, np.int8)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those ``(a, b)`` of ``pairs`` that are similar enough."""

    def run(batches):
        for batch in batches:
            ids = [batch.column(c).to_pylist() for c in range(2, 6)]
            good = [similar(_set(p, q), _set(r, s)) >= LEAST for p, q, r, s in zip(*ids, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("ids").alias("ia"), F.col("levels").alias("la"))
    right = sets.select(F.col("node").alias("b"), F.col("ids").alias("ib"), F.col("levels").alias("lb"))
    wide = pairs.join(right, "b").join(left, "a").select("a", "b", "ia", "la", "ib", "lb")
    return wide.mapInArrow(run, "a long, b long")


def block_similar(left: list[tuple], right: list[tuple]) -> np.ndarray:
    """``similar`` for all of two blocks, by products of matrices over the ids that both hold."""

    def table(sets):
        row = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
        return row, np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]).astype(np.int64)

    (r1, i1, l1), (r2, i2, l2) = table(left), table(right)
    total1, total2 = np.bincount(r1, weight(l1), len(left)), np.bincount(r2, weight(l2), len(right))
    size1, size2 = np.bincount(r1, minlength=len(left)), np.bincount(r2, minlength=len(right))
    shared = np.intersect1d(i1, i2)
    kept1, kept2 = np.isin(i1, shared), np.isin(i2, shared)
    r1, i1, l1 = r1[kept1], i1[kept1], l1[kept1]
    r2, i2, l2 = r2[kept2], i2[kept2], l2[kept2]
    place1, place2 = np.searchsorted(shared, i1), np.searchsorted(shared, i2)
    mass = np.zeros((len(left), len(right)))
    count = np.zeros((len(left), len(right)))
    for start in range(0, len(shared), 4096):  # columns at a time, so memory stays bounded
        width = min(4096, len(shared) - start)
        m1, m2 = np.full((len(left), width), -1, np.int64), np.full((len(right), width), -1, np.int64)
        here1, here2 = (place1 >= start) & (place1 < start + width), (place2 >= start) & (place2 < start + width)
        m1[r1[here1], place1[here1] - start] = l1[here1]
        m2[r2[here2], place2[here2] - start] = l2[here2]
        count += (m1 >= 0).astype(np.float32) @ (m2 >= 0).astype(np.float32).T
        # the smaller of two weights is the sum of the steps that both reach
        steps = np.union1d(l1[here1], l2[here2])
        below = 0.0
        for level in steps.tolist():
            w = float(np.exp(level * GRAIN))
            mass += (w - below) * ((m1 >= level).astype(np.float32) @ (m2 >= level).astype(np.float32).T)
            below = w
    weighted = mass / (total1[:, None] + total2[None, :] - mass)
    plain = count / (size1[:, None] + size2[None, :] - count)
    return np.maximum(weighted, plain)


def components(links: DataFrame) -> DataFrame:
    """``(node, comp)`` of all nodes with links: least node that can be reached.

    Each round takes the least label of the neighbours and follows labels twice; a round
    counts what changed, and tables are written once a round.
    """
    both = cut_lineage(links.union(links.select("b", "a")).toDF("a", "b").distinct())
    label = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).toDF("node", "comp"))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = label.join(near.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "near").alias("new"))
        jump = label.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        after = cut_lineage(
            step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("comp"), F.col("comp").alias("old"))
        )
        settled = after.where("comp <> old").isEmpty()
        release(label)
        label = after
        if settled:
            release(both)
            return label


def _classed(members: DataFrame, label: DataFrame | None) -> DataFrame:
    if label is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(label.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that hold several classes, with the buckets' sizes."""
    mixed = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return members.join(mixed.select("bucket"), "bucket")


def find_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that join the nodes of each bucket of ``(bucket, node, near)`` into its classes.

    near: how many nodes a node meets in all its buckets. The best-connected node of a bucket
    is its centre, so that buckets of one family tend to have the same.
    """
    found, label, centres, held = None, None, None, None
    for _ in range(STARS):
        rows = cut_lineage(_open(_classed(members, label)))
        free = rows if centres is None else rows.join(centres.select("bucket", F.col("a").alias("node")), ["bucket", "node"], "left_anti")
        centre = cut_lineage(
            free.groupBy("bucket").agg(F.max_by(F.struct("node", "comp", "near"), F.struct("near", "node")).alias("c"))
            .select("bucket", F.col("c.node").alias("a"), F.col("c.comp").alias("ac"), F.col("c.near").alias("reach"))
        )
        met = rows.join(centre, "bucket").where("comp <> ac")
        # of the centres of its buckets, a node asks the one with which it shares most of them
        often = met.groupBy(F.col("node").alias("b"), "a").agg(F.count("*").alias("n"), F.max("reach").alias("reach"))
        best = F.max_by("a", F.struct("n", "reach", "a")).alias("a")
        pairs = cut_lineage(often.groupBy("b").agg(best).select("a", "b"))
        # a centre that every other class of its bucket has asked is done there
        asked = pairs.select(F.col("b").alias("node"), F.col("a").alias("asked"))
        missed = met.join(asked, "node").groupBy("bucket").agg(F.max(F.col("asked") != F.col("a")).alias("missed"))
        done = centre.join(missed.where("missed").select("bucket"), "bucket", "left_anti").select("bucket", F.col("a").alias("node"))
        members = cut_lineage(rows.join(done, ["bucket", "node"], "left_anti").select("bucket", "node", "near"))
        links = cut_lineage(linked(pairs, sets))
        both = links if found is None else cut_lineage(found.union(links))
        after = components(both)
        release(rows, pairs, *(t for t in (found, label, centres, held) if t is not None), *([links] if both is not links else []))
        found, label, centres, held = both, after, centre, members
    rows = cut_lineage(_open(_classed(members, label)))
    sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    most = cut_lineage(
        sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
        .select("bucket", F.col("top.comp").alias("top"), "all", (F.col("all") - F.col("top.n")).alias("outer"))
    )
    marked = rows.join(most, "bucket").select(
        "bucket", "node", "comp", (F.col("comp") != F.col("top")).alias("out"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("n_in"), F.ceil(F.col("outer") / BLOCK).cast("int").alias("n_out"),
    )
    own = F.pmod(F.xxhash64("node", F.lit(9)), F.col("n_in")).cast("int")
    own_out = F.pmod(F.xxhash64("node", F.lit(9)), F.col("n_out")).cast("int")
    inner = marked.select("bucket", "node", "comp", own.alias("j"), F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("i"))
    outer = marked.where("out").select("bucket", "node", "comp", own_out.alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_in") - 1)).alias("j"))
    keys = ["bucket", "i", "j"]

    def compare(left, right):
        def parts(table):
            ids, levels = table.column("ids").to_pylist(), table.column("levels").to_pylist()
            sets = [_set(x, y) for x, y in zip(ids, levels, strict=True)]
            return table.column("node").to_numpy(), table.column("comp").to_numpy(), sets

        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        (a, ca, sa), (b, cb, sb) = parts(left), parts(right)
        x, y = np.nonzero((block_similar(sa, sb) >= LEAST) & (ca[:, None] != cb[None, :]))
        return pa.table({"a": pa.array(a[x]), "b": pa.array(b[y])})

    columns = [*keys, "node", "comp", "ids", "levels"]
    left, right = (side.join(sets, "node").select(*[F.col(c).alias(c) for c in columns]) for side in (outer, inner))
    rest = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "a long, b long")
    every = cut_lineage(found.union(rest).distinct())
    release(rows, most, found, label, centres, held)
    return every


def _key(rows: DataFrame):
    """A document's id for joins, next to its digests; a null id counts as 0."""
    return F.coalesce(F.col("doc_id"), F.lit(0).cast(rows.schema["doc_id"].dataType)).alias("key")


def _classed_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, d1, d2, comp)`` of each row; comp is null without words."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(idf_levels(docs))
    signed = cut_lineage(signatures(docs, idf))
    rows = cut_lineage(signed.drop("bands"))
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"))
    banded = nodes.select("node", F.posexplode("bands")).select("node", F.xxhash64("pos", "col").alias("bucket"))
    several = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut_lineage(banded.join(several, "bucket").select("bucket", "node", "n"))
    release(signed)
    near = shared.groupBy("node").agg(F.sum("n").alias("near"))
    members = cut_lineage(shared.join(near, "node").select("bucket", "node", "near"))
    release(shared)
    one = rows.select("node", F.struct(_key(rows), "d1", "d2").alias("t")).groupBy("node").agg(F.min("t").alias("t"))
    wanted = cut_lineage(one.join(members.select("node").distinct(), "node").select("t.*", "node"))
    sets = cut_lineage(_shingle_sets(docs, wanted, idf))
    links = find_links(members, sets)
    release(wanted, sets, members)
    label = components(links)
    named = cut_lineage(
        rows.join(label.select("node", "comp"), "node", "left").select("doc_id", "d1", "d2", F.coalesce("comp", "node").alias("comp"))
    )
    release(rows, links, label)
    return named


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, class_id)`` of each row."""
    named = _classed_rows(docs)
    least = named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    return named.join(least, "comp", "left").select(
        "doc_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, the one of least id (a null id counts as 0); rows without words stay."""
    named = _classed_rows(docs)
    named = named.select("comp", _key(named), "d1", "d2")
    times = named.groupBy("key", "d1", "d2").agg(F.count("*").alias("n"))
    first = named.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct("key", "d1", "d2")).alias("t")).select("t.*")
    wordless = named.where("comp IS NULL").select("key", "d1", "d2").distinct().withColumn("n", F.lit(1))
    wanted = first.join(times, ["key", "d1", "d2"]).select("key", "d1", "d2", "n").union(wordless)
    ids = ["__key", "__d1", "__d2"]
    wanted = cut_lineage(wanted.toDF(*ids, "__n"))
    keyed = docs.select("*", *[c.alias(i) for i, c in zip(ids, [_key(docs), *text_key()], strict=True)])
    kept = keyed.join(wanted, ids)
    again = kept.where("__n > 1").dropDuplicates(ids)  # rows that repeat as a whole
    return kept.where("__n = 1").union(again).select(*docs.columns)
