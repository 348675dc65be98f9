"""Repeated long strings across documents, by prefix doubling over sampled places.

A string of ``min_bytes`` bytes that starts at two places is a repeat; every byte that a
repeat covers is removed. Places are in the UTF-8 bytes of the whole text and strings
never cross documents. Repeats of several lengths can be found in one pass: removal goes by one
length, shorter passages are only counted.

1. *Places.* Each window of places (a third of ``min_bytes``, WINDOW at most) has the place with the
   least hash of its ``GRAM`` bytes as its anchor, and an anchor owns the starts whose first
   window has it. Equal strings have equal anchors, so only anchors (at 400 bytes one in about
   55 bytes) are ranked, not every byte, and a document sends each different one once.
2. *Prefix doubling.* Rank 0 stands for the first h bytes after an anchor. Then the pairs
   ``(rank of the first h bytes, digest of the next h bytes)`` at doubled offsets h are
   sorted and ranked again. An anchor whose pair is unique goes; ranks stop past two thirds of
   ``min_bytes``, the bytes after an anchor that every repeat with a start of its own shares. Of several
   lengths each has the rank of the last offset within the bytes that its own repeats share.
3. *Blocks.* A block holds all bytes of the strings from an anchor's starts. Blocks that are
   equal decide all their starts at once.
4. *Edges.* Where blocks share ranks but differ, one block of each kind is split into steps
   of ``STEP`` starts. Steps that are equal decide all their starts at once, too. Where steps differ
   but the bytes that all strings of a step share are equal, one step of each kind is split into
   single starts, and the digests of their strings decide.

Digests of blocks and strings have 128 bits. Groups are counted with partial sums and joined
back with plain joins, which Spark splits when one phrase holds most rows; no group is
collected. A document's own anchors are handled together (bounded by its length).

Defined results: null and empty texts have no bytes; texts that are equal (also rows that
repeat with the same id) count as separate documents, so each is fully removed if it has
``min_bytes`` bytes; null ids are kept as they are; other columns are not read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.llm.common import CHUNK_BYTES, raw_texts, text_key
from themescope.llm.rolling import Prefix, grams, mix, window_min
from themescope.session import cut_lineage, release

MIN_BYTES = 400
#: Bytes of a passage that is counted beside the removal: fifty words are about 300 bytes in the
#: languages of the corpus, with short words 240.
PASSAGE_BYTES = 240
#: Longest window, shortest window and bytes of a hashed gram.
WINDOW = 128
LEAST_WINDOW = 32
GRAM = 16
#: Starts that are checked together at the edges of repeats.
STEP = 16


def _window(lengths: tuple[int, ...]) -> int:
    """Places from which an anchor is chosen; a window and its grams fill at most a third of the longest
    repeat and three fifths of the shortest."""
    window = min(WINDOW, (lengths[-1] - GRAM) // 3, lengths[0] * 3 // 5 - GRAM)
    if window < LEAST_WINDOW:
        raise ValueError(f"repeats must be of {3 * LEAST_WINDOW + GRAM} bytes or more")
    return window


def _reach(lengths: tuple[int, ...], size: int) -> int:
    """Bytes after an anchor that a repeat of ``size`` shares: a start that the anchor owns is less than a window before it."""
    return size - _window(lengths) + 1


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]):
    """Anchors of texts that lie one after another in ``data``.

    Returns the anchors' places, the text each is in, the first start that each owns and, for
    each length, the last (last < first where it owns none).
    """
    window = _window(lengths)
    gram = grams(data, GRAM)
    keys = (mix(gram) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    least = (window_min(keys, window) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), ends - starts)[: len(least)]
    place = np.arange(len(least))
    good = place + window + GRAM - 1 <= ends[text]
    least, text, place = least[good], text[good], place[good]
    first = np.flatnonzero(np.diff(least, prepend=-1))
    last = np.append(first[1:], len(least)) - 1 if len(first) else first
    at, of, lo = least[first], text[first], place[first]
    lasts = [np.minimum(place[last], ends[of] - n) for n in lengths]
    own = lasts[0] >= lo
    return at[own], of[own], lo[own], [hi[own] for hi in lasts]


def _chunked(texts: list[bytes], least: int):
    """Texts of ``least`` bytes and more, put together in parts of about CHUNK_BYTES."""
    part, size = [], 0
    for i, x in enumerate(texts):
        if len(x) < least:
            continue
        part.append(i)
        size += len(x)
        if size >= CHUNK_BYTES // 4:
            yield part
            part, size = [], 0
    if part:
        yield part


def _joined(texts: list[bytes], part: list[int]):
    data = np.frombuffer(b"".join(texts[i] for i in part), np.uint8)
    ends = np.cumsum([len(texts[i]) for i in part])
    return data, ends - [len(texts[i]) for i in part], ends


def _pieces(lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    """Parts after an anchor that are named: first h bytes, then the next h, 2h, 4h, ..."""
    reach = _reach(lengths, lengths[0])
    rounds = max(1, (reach // 64).bit_length() - 1)
    h = reach >> rounds
    while h << (rounds + 1) <= _reach(lengths, lengths[-1]):
        rounds += 1
    return [(0, h)] + [(h << j, h << (j + 1)) for j in range(rounds)]


def _levels(lengths: tuple[int, ...]) -> list[int]:
    """For each length the last part that all its repeats share."""
    return [max(j for j, (_, end) in enumerate(_pieces(lengths)) if end <= _reach(lengths, n)) for n in lengths]


def _names(data: np.ndarray, at: np.ndarray, lo: np.ndarray, lasts: list[np.ndarray], lengths: tuple[int, ...]):
    """Names of the parts; 0 where no repeat that the anchor owns is long enough to share a part."""
    prefix, names, levels = Prefix(data), [], _levels(lengths)
    for j, (a, b) in enumerate(_pieces(lengths)):
        hi = next(hi for hi, level in zip(lasts, levels, strict=True) if level >= j)
        whole, name = hi >= lo, np.zeros(len(at), np.int64)
        named = prefix.of(at[whole] + a, at[whole] + b)
        name[whole] = np.maximum(named, np.uint64(1)).view(np.int64)
        names.append(name)
    return names


def _places(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """``(d1, n0, n1, ..., many0, ...)``: names after each anchor that owns starts; many: twice in the text, for each length."""
    columns = [f"n{j}" for j in range(len(_pieces(lengths)))]
    many = [f"many{k}" for k in range(len(lengths))]

    def run(batches):
        for batch in batches:
            texts, ids = raw_texts(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            for part in _chunked(texts, lengths[0]):
                data, starts, ends = _joined(texts, part)
                at, of, lo, lasts = anchors(data, starts, ends, lengths)
                names = _names(data, at, lo, lasts, lengths)
                _, first = np.unique(_keys(of, names), return_index=True)
                again = []
                for level in _levels(lengths):
                    _, kind, times = np.unique(_keys(of, names[: level + 1]), return_inverse=True, return_counts=True)
                    again.append(pa.array((times > 1)[kind[first]]))
                arrays = [pa.array(ids[np.array(part)[of[first]]]), *[pa.array(n[first]) for n in names]]
                yield pa.RecordBatch.from_arrays([*arrays, *again], names=["d1", *columns, *many])

    kinds = ", ".join([f"{c} long" for c in columns] + [f"{c} boolean" for c in many])
    return docs.select("d1", "text").mapInArrow(run, f"d1 long, {kinds}")


def _ranked(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Number the keys in sorted order; the table is written, so numbers stay."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(
        pairs.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id())
    )


def candidates(docs: DataFrame, lengths: tuple[int, ...] = (MIN_BYTES,)) -> DataFrame:
    """``(d1, n0, n1, ..., core0, ...)``: names of anchors whose following bytes repeat, and their rank
    for each length (-1 where none repeats that is as long)."""
    level, levels = _places(docs, lengths), _levels(lengths)
    columns = [c for c in level.columns if c.startswith("n")]
    cores = [f"core{k}" for k in range(len(lengths))]
    old = []
    for j, name in enumerate(columns):  # the next part at the doubled offset
        keys = ["r", name] if j else [name]
        open_ = [k for k, at in enumerate(levels) if at >= j]  # lengths that go on
        twice = (
            level.where(" AND ".join([f"{name} <> 0", *(["r IS NOT NULL"] if j else [])]))
            .groupBy(*keys)
            .agg(F.min("d1").alias("a"), F.max("d1").alias("b"), F.max(f"many{open_[0]}").alias("many"))
            .where("many OR a <> b")
            .select(*keys)
        )
        ranks = _ranked(twice, keys)
        # what repeats for a shorter length stays
        level = level.join(ranks, keys, "left" if open_[0] else "inner").drop("r").withColumnRenamed("rank", "r")
        for k in open_:
            if levels[k] == j:
                level = level.withColumn(cores[k], F.coalesce("r", F.lit(-1).cast("long")))
        if j < len(columns) - 1:
            level = cut_lineage(level)
            release(ranks, *old)
            old = [level]
    return level.select("d1", *columns, *cores)


def _keys(of: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """A hash for each (text, numbers)."""
    key = of.astype(np.uint64)
    for x in parts:
        key = mix(key + np.ascontiguousarray(x).view(np.uint64))
    return key


def _digests(data: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """128-bit digests of the n bytes from each lo on, as rows of two longs."""
    import xxhash

    view, digest = memoryview(data), xxhash.xxh3_128_digest
    out = b"".join([digest(view[a : a + k]) for a, k in zip(lo.tolist(), n.tolist(), strict=True)])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


class Repeats(NamedTuple):
    """``texts``: (d1, d2, text) of texts that may hold repeats; ``spans``: (d1, d2, spans), lists of (lo, hi, size),
    starts of repeats of a size."""

    texts: DataFrame
    spans: DataFrame


def repeats(docs: DataFrame, lengths: tuple[int, ...] = (MIN_BYTES,)) -> Repeats:
    """Repeats of all different texts of ``(doc_id, text)``, each text once; lengths go up."""
    keyed = docs.select("doc_id", "text", *text_key()).withColumn("key", F.xxhash64("doc_id"))
    found = candidates(keyed, lengths).distinct()
    names, cores = ([c for c in found.columns if c.startswith(x)] for x in ("n", "core"))
    lists = found.groupBy("d1").agg(F.collect_list(F.struct(*names, *cores)).alias("found"))
    one = keyed.groupBy("d1", "d2").agg(F.min("key").alias("key"))  # the row that stands for a text
    wanted = cut_lineage(one.join(lists, "d1"))
    texts = cut_lineage(keyed.join(wanted, ["d1", "d2", "key"]).select("d1", "d2", "text", "found"))
    release(wanted)

    def blocks(batches):
        for batch in batches:
            raw, lists = raw_texts(batch.column(2)), batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            listed = {c: v.to_numpy() for c, v in zip((*names, *cores), lists.flatten().flatten(), strict=True)}
            holder = np.repeat(np.arange(len(raw)), sizes)
            for part in _chunked(raw, lengths[0]):
                text = np.array(part)
                data, starts, ends = _joined(raw, part)
                places, owner, firsts, lasts = anchors(data, starts, ends, lengths)
                # the cores of each anchor, found by its text and names
                inside = np.flatnonzero(np.isin(holder, text))
                known = _keys(holder[inside], [listed[n][inside] for n in names])
                order = np.argsort(known)
                known, inside = known[order], inside[order]
                key = _keys(text[owner], _names(data, places, firsts, lasts, lengths))
                near = np.minimum(np.searchsorted(known, key), len(known) - 1)
                there = np.flatnonzero(known[near] == key) if len(known) else near[:0]
                for size, last, name in zip(lengths, lasts, cores, strict=True):
                    core = listed[name][inside[near[there]]]
                    good = (core >= 0) & (last[there] >= firsts[there])
                    j, core = there[good], core[good]
                    if not len(j):
                        continue
                    at, of, lo, hi = places[j], owner[j], firsts[j], last[j]
                    both = _digests(data, lo, hi - lo + size)
                    _, first, kind, times = np.unique(
                        _keys(of, [both[:, 0], hi - lo]), return_index=True, return_inverse=True, return_counts=True
                    )
                    again = times[kind] > 1  # blocks that a text holds twice are decided here
                    runs = _merged(lo[again], hi[again])  # texts are further apart than a run's starts
                    n = len(first) + len(runs)
                    whose = np.concatenate([of[first], np.searchsorted(ends, runs[:, 0], side="right")])
                    base, whose = starts[whose], text[whose]
                    own = [batch.column(c).take(pa.array(whose)) for c in (0, 1)]
                    numbers = [
                        (np.concatenate([v[first], r]) - base).astype(np.int32)
                        for v, r in ((at, runs[:, 0]), (lo, runs[:, 0]), (hi, runs[:, 1]))
                    ]
                    decided = pa.array(np.arange(n) >= len(first))
                    longs = [np.concatenate([v[first], np.zeros(len(runs), np.int64)]) for v in (core, both[:, 0], both[:, 1])]
                    here = np.concatenate([times > 1, np.ones(len(runs), bool)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *own, *map(pa.array, numbers), pa.array(np.full(n, size, np.int32)),
                            *map(pa.array, longs), pa.array(here), decided,
                        ],
                        names=["d1", "d2", "at", "lo", "hi", "size", "core", "h1", "h2", "twice", "decided"],
                    )

    rows = cut_lineage(
        texts.mapInArrow(
            blocks,
            "d1 long, d2 long, at int, lo int, hi int, size int, core long, h1 long, h2 long, twice boolean, decided boolean",
        )
    )
    whole, asked, kinds = _settled(rows.where("NOT decided"))
    bare = texts.select("d1", "d2", "text")
    steps = cut_lineage(bare.join(asked, ["d1", "d2"]).mapInArrow(_digester(_steps, lengths[0]), _DIGESTED))
    shared = steps.groupBy("core", "size").agg(F.count("*").alias("n")).where("n > 1").select("core", "size")
    close = cut_lineage(steps.join(shared, ["core", "size"]))
    release(steps)
    even, near, close_kinds = _settled(close)
    edges = cut_lineage(bare.join(near, ["d1", "d2"]).mapInArrow(_digester(_singles, lengths[0]), _DIGESTED))
    again = edges.groupBy(*_SAME).agg(_differ().alias("__differ")).where("__differ").select(*_SAME)
    parts = edges.where("NOT twice").join(again, _SAME).select(*_SPAN)
    spans = rows.where("decided").select(*_SPAN).unionByName(whole).unionByName(even).unionByName(parts)
    spans = cut_lineage(spans.groupBy("d1", "d2").agg(F.collect_list(F.struct("lo", "hi", "size")).alias("spans")))
    release(rows, kinds, close, close_kinds, edges)
    return Repeats(bare, spans)


#: Columns of equal strings, and of the starts of repeats.
_SAME = ["h1", "h2", "size"]
_SPAN = ["d1", "d2", "lo", "hi", "size"]


def _settled(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans of rows (blocks or steps) that are equal to another; by text, one row of each kind where
    several kinds have the same core; and the table of kinds. ``twice``: all starts of the kind are repeats."""
    kinds = cut_lineage(
        rows.groupBy(*_SAME).agg(
            F.min("core").alias("core"),
            F.min(F.struct("d1", "d2", "at", "lo", "hi")).alias("first"),
            (F.max("twice") | _differ()).alias("twice"),
        )
    )
    whole = rows.where("NOT twice").join(kinds.where("twice").select(*_SAME), _SAME).select(*_SPAN)
    mixed = kinds.groupBy("core", "size").agg(F.count("*").alias("n")).where("n > 1").select("core", "size")
    asked = (
        kinds.join(mixed, ["core", "size"])
        .select("first.*", "size", "twice")
        .groupBy("d1", "d2")
        .agg(F.collect_list(F.struct("at", "lo", "hi", "size", "twice")).alias("asked"))
    )
    return whole, asked, kinds


def _differ():
    """Whether the rows of a group lie at two or more different places."""
    place = F.xxhash64("d1", "d2", "lo")
    return F.min(place) != F.max(place)


def _merged(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Runs of starts as rows (first, last)."""
    if not len(lo):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(lo)
    lo, hi = lo[order], hi[order]
    new = np.flatnonzero(np.append(True, lo[1:] > np.maximum.accumulate(hi)[:-1] + 1))
    return np.column_stack([lo[new], np.maximum.reduceat(hi, new)])


_DIGESTED = "d1 long, d2 long, at int, lo int, hi int, size int, twice boolean, core long, h1 long, h2 long"


def _steps(at, lo, hi, size):
    """Starts of a block by their distance to the anchor, in fixed steps; all strings of a step
    share the bytes from its last start to the end of its first start's string.

    (block, first and last start, where the shared bytes begin, how many they are) of each step. The core of
    a step stands for them.
    """
    few = (at - hi) // STEP
    many = (at - lo) // STEP + 1 - few
    block = np.repeat(np.arange(len(at)), many)
    b = np.repeat(few - np.cumsum(many) + many, many) + np.arange(len(block))
    last = at[block] - b * STEP
    return block, np.maximum(last - STEP + 1, lo[block]), np.minimum(last, hi[block]), last, size[block] - STEP + 1


def _singles(at, lo, hi, size):
    many = hi - lo + 1
    block = np.repeat(np.arange(len(at)), many)
    start = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(len(block))
    return block, start, start, start, size[block]


def _digester(split, least: int):
    def run(batches):
        for batch in batches:
            raw, lists = raw_texts(batch.column(2)), batch.column(3)
            asked = [c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()]
            edges = np.cumsum(np.append(0, np.diff(lists.offsets.to_numpy())))
            for part in _chunked(raw, least):
                data, starts, _ = _joined(raw, part)
                many = edges[np.array(part) + 1] - edges[part]
                pick = np.repeat(edges[part] - np.cumsum(many) + many, many) + np.arange(many.sum())
                base = np.repeat(starts, many)
                at, lo, hi = (asked[c][pick].astype(np.int64) + base for c in range(3))
                size, text = asked[3][pick], np.repeat(np.array(part), many)
                block, first, last, begin, shared = split(at, lo, hi, size)
                both = _digests(data, first, last - first + size[block])
                core = _digests(data, begin, shared)[:, 0] if split is _steps else np.zeros(len(begin), np.int64)
                own = [batch.column(c).take(pa.array(text[block])) for c in (0, 1)]
                numbers = [pa.array((v - base[block]).astype(np.int32)) for v in (at[block], first, last)]
                longs = [pa.array(np.ascontiguousarray(v)) for v in (core, both[:, 0], both[:, 1])]
                yield pa.RecordBatch.from_arrays(
                    [*own, *numbers, pa.array(size[block]), pa.array(asked[4][pick][block].astype(bool)), *longs],
                    names=["d1", "d2", "at", "lo", "hi", "size", "twice", "core", "h1", "h2"],
                )

    return run


def _cut(text: bytes, spans: list, size: int) -> tuple[int, int, bytes]:
    """Bytes covered by repeats of ``size``, runs of them, bytes left."""
    spans = sorted((s["lo"], s["hi"] + size) for s in spans if s["size"] == size)
    kept, runs, done, removed = [], 0, 0, 0
    start, end = None, -1
    for a, b in [*spans, (len(text) + size, None)]:
        if a <= end:
            end = max(end, b)
            continue
        if start is not None:
            kept.append(text[done:start])
            done, runs, removed = end, runs + 1, removed + end - start
        start, end = a, b
    kept.append(text[done:])
    return removed, runs, b"".join(kept)


def digests(docs: DataFrame, min_bytes: int = MIN_BYTES, passage_bytes: int | None = None) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of each row of ``docs``.

    With ``passage_bytes`` also ``n_passage_bytes, n_passages``: bytes that repeats of that
    length cover, and maximal runs of them. These bytes are counted, not removed.
    """
    text = F.coalesce("text", F.lit(""))
    ids = cut_lineage(
        docs.select("doc_id", *text_key(), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    )
    copies = ids.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").select("d1", "d2", F.lit(True).alias("copied"))
    asked = {"n_removed": min_bytes} if passage_bytes is None else {"n_removed": min_bytes, "n_passage_bytes": passage_bytes}
    runs_of = {"n_removed": "n_spans", "n_passage_bytes": "n_passages"}
    found = repeats(docs, tuple(sorted(set(asked.values()))))

    def cut(batches):
        for batch in batches:
            rows = list(zip(raw_texts(batch.column(2)), batch.column(3).to_pylist(), strict=True))
            out = {c: [_cut(x, s, n) for x, s in rows] for c, n in asked.items()}
            arrays = [pa.array([x[i] for x in made], pa.int64()) for made in out.values() for i in (0, 1)]
            left = pa.array([hashlib.sha256(x[2]).hexdigest() for x in out["n_removed"]], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), left, *arrays],
                names=["d1", "d2", "left_sha", *[c for k in asked for c in (k, runs_of[k])]],
            )

    kinds = "".join(f", {k} long, {runs_of[k]} long" for k in asked)
    cuts = (
        found.texts.join(found.spans, ["d1", "d2"])
        .mapInArrow(cut, f"d1 long, d2 long, left_sha string{kinds}")
        .dropDuplicates(["d1", "d2"])
    )
    decided = cut_lineage(cuts.join(copies, ["d1", "d2"], "full_outer"))

    def counted(column: str, size: int, whole):
        all_of = F.col("copied") & (F.col("n_bytes") >= size)
        return F.when(all_of, whole).otherwise(F.coalesce(column, F.lit(0))).cast("long").alias(column)

    counts = [counted(*x) for k, n in asked.items() for x in ((k, n, F.col("n_bytes")), (runs_of[k], n, F.lit(1)))]
    sha = (
        F.when(F.col("copied") & (F.col("n_bytes") >= min_bytes), F.lit(hashlib.sha256(b"").hexdigest()))
        .otherwise(F.coalesce("left_sha", "sha"))
        .alias("kept_sha256")
    )
    return ids.join(decided, ["d1", "d2"], "left").select("doc_id", "n_bytes", *counts[:2], sha, *counts[2:])


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``docs`` with all repeats cut out of ``text``; other columns stay as they are.

    A cut inside a character drops the rest of that character.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("*", *[c.alias(f"__{n}") for n, c in zip(("d1", "d2"), text_key(), strict=True)])
    copies = keyed.groupBy("__d1", "__d2").agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    copies = copies.withColumn("__copied", F.lit(True))
    found = repeats(docs, (min_bytes,))
    lists = found.spans.select(F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), F.col("spans").alias("__spans"))
    marked = keyed.join(cut_lineage(lists.join(copies, ["__d1", "__d2"], "full_outer")), ["__d1", "__d2"], "left")
    names, at = docs.columns, marked.columns.index("text")
    keep = [marked.columns.index(c) for c in names]

    def cut(batches):
        for batch in batches:
            spans, copied = batch.column("__spans").to_pylist(), batch.column("__copied").to_pylist()
            out = []
            for x, s, c in zip(raw_texts(batch.column(at)), spans, copied, strict=True):
                left = b"" if c and len(x) >= min_bytes else _cut(x, s, min_bytes)[2] if s else x
                out.append(left.decode("utf-8", "ignore"))
            columns = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in keep]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.mapInArrow(cut, docs.schema)
