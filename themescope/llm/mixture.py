"""Packing that keeps every window at the sources' target proportions of tokens.

Documents become ids (and an end id); each source is a queue of its documents' ids. Windows of
``row`` ids are filled from the queues by deficit round-robin: a queue earns its share of each
window, is served in grains of GRAIN ids, and what it is owed or has had too much (less than
a few grains) is carried to the next window, over all partitions. A queue that runs dry leaves
its share to the others. Within a window a queue's grains are next to each other, so a text is
cut only at edges of windows and of a queue's part of a window.

The round-robin needs no walk over the windows: grain j of a queue of weight w is served at
time ``(j + 1) / w``, ties by queue, so how many grains each queue has had before any window
follows from the queues' totals alone (``Schedule``). Spark gives the rest: one pass encodes the
texts, writes the ids and counts tokens by task and source; sums over the tasks say where
each task's documents stand in their queue; a second pass cuts them. No ids are shuffled as
long as these sums, a line for each task and source, are small enough for the planner to broadcast.

Full windows have no padding. What is left at the end (less than a window) is cut into rows of
power-of-two length, which need none either. The last part of each queue, shorter than a
grain, follows after all full grains.

Without ``targets`` a source's target is its own share of all tokens, so the queues end together.
At most QUEUES sources have a queue of their own (those with targets, then the largest); further
ones share one queue, in which they stand in order of tasks.

Defined results: null and empty texts have just the end id; a null source counts as '';
repeated rows are packed again; null ids stay null; invalid UTF-8 is replaced before encoding;
special strings in a text are ordinary text; an empty table gives no rows; other columns are
never read. Memory is bounded by the longest text.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themescope.llm.common import raw_texts, slices
from themescope.session import cut_lineage

ROW = 2048
GRAIN = 128
END = 1
QUEUES = 256
#: Shares are whole numbers of 2**-UNIT.
UNIT = 20


def vocabulary_ranks(path: str) -> list[bytes]:
    """Tokens by id from the file of a byte-level BPE, whose ids are the ranks of its merges.

    Such files write each byte as a printable character: printable Latin-1 stands for itself,
    the other bytes, in order, for the characters from 256 on.
    """
    with open(path, encoding="utf-8") as lines:
        model = json.load(lines)["model"]
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    byte = {chr(b): b for b in plain}
    byte |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    tokens = [token for token, _ in sorted(model["vocab"].items(), key=lambda item: item[1])]
    return [bytes(byte[c] for c in token) for token in tokens]


class Schedule:
    """Where each id of each queue stands, from the queues' totals and weights."""

    def __init__(self, totals: list[int], shares: list[float], row: int = ROW, grain: int = GRAIN):
        if row % grain:
            raise ValueError("a row holds whole grains")
        self.row, self.grain, self.per = row, grain, row // grain
        totals = np.array(totals, np.int64)
        most = max(shares, default=1) or 1
        self.weight = np.array([max(1, round(s / most * (1 << UNIT))) for s in shares], np.int64)
        self.full, tail = totals // grain, totals % grain
        self.last = (self.full << UNIT) // self.weight  # time, in units, of a queue's last grain
        self.grains = int(self.full.sum())
        self.tail_at = self.grains * grain + np.cumsum(tail) - tail
        total = int(totals.sum())
        rest = total % row
        self.whole = total // row
        sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.edges = np.cumsum([0, *sizes])  # of the rows after the whole ones

    def _had(self, time: np.ndarray) -> np.ndarray:
        """Grains of each queue (columns) served up to each time."""
        time = time[:, None]
        part = ((np.minimum(time, self.last) + 1) * self.weight - 1) >> UNIT
        return np.where(time >= self.last, self.full, np.maximum(part, 0))

    def before_window(self, window: np.ndarray) -> np.ndarray:
        """Grains of each queue (columns) served before each window."""
        wanted = window * self.per
        low = np.full(len(window), -1, np.int64)
        high = np.full(len(window), int(self.last.max(initial=0)) + 1, np.int64)
        while (high - low > 1).any():  # the last time at which no more than wanted are served
            middle = (low + high) // 2
            fits = self._had(middle).sum(1) <= wanted
            low, high = np.where(fits, middle, low), np.where(fits, high, middle)
        had = self._had(low)
        more = self._had(low + 1) - had  # at most one a queue, in order of queues
        return had + more * (np.cumsum(more, 1) <= (wanted - had.sum(1))[:, None])

    def window(self, queue: np.ndarray, grain: np.ndarray) -> np.ndarray:
        """The window of full grains."""
        time = ((grain + 1) << UNIT) // self.weight[queue]
        had = self._had(time - 1)
        same = np.cumsum(self._had(time) - had, 1)
        return (had.sum(1) + same[np.arange(len(queue)), queue] - 1) // self.per

    def place(self, queue: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Place among all ids of the first id of parts that lie within a grain."""
        at = begin // self.grain
        out = self.tail_at[queue] + begin - self.full[queue] * self.grain
        full = np.flatnonzero(at < self.full[queue])
        if len(full):
            window, which = np.unique(self.window(queue[full], at[full]), return_inverse=True)
            before = self.before_window(window)
            first = np.cumsum(self.before_window(window + 1) - before, 1)
            first[:, 1:], first[:, 0] = first[:, :-1].copy(), 0  # grains of earlier queues in the window
            mine = first[which, queue[full]] + at[full] - before[which, queue[full]]
            out[full] = window[which] * self.row + mine * self.grain + begin[full] % self.grain
        return out

    def pieces(self, queue: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """(text, start, length, row, offset) of the pieces of texts, given by place in their queue."""
        grains = (begin + size - 1) // self.grain - begin // self.grain + 1
        text = np.repeat(np.arange(len(queue)), grains)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(grains) - grains, grains)
        cut = (begin[text] // self.grain + nth) * self.grain
        low = np.maximum(cut, begin[text])
        length = np.minimum(cut + self.grain, begin[text] + size[text]) - low
        place = self.place(queue[text], low)
        start = low - begin[text]
        done = []
        while len(text):  # parts after the last full grain may reach over the end of a row
            in_rest = place - self.whole * self.row
            last = np.searchsorted(self.edges, np.maximum(in_rest, 0), side="right") - 1
            row = np.where(in_rest < 0, place // self.row, self.whole + last)
            row_at = np.where(in_rest < 0, row * self.row, self.whole * self.row + self.edges[last])
            ends = np.append(self.edges, self.edges[-1])[last + 1]
            row_end = np.where(in_rest < 0, row_at + self.row, self.whole * self.row + ends)
            fits = np.minimum(length, row_end - place)
            done.append(np.stack([text, start, fits, row, place - row_at]))
            more = length > fits
            text, start, length, place = text[more], (start + fits)[more], (length - fits)[more], (place + fits)[more]
        out = np.concatenate(done, 1) if done else np.zeros((5, 0), np.int64)
        text, start, length, row, offset = out[:, np.lexsort((out[1], out[0]))]
        new = np.ones(len(text), bool)
        new[1:] = (np.diff(text) != 0) | (np.diff(row) != 0) | (offset[1:] != offset[:-1] + length[:-1])
        heads = np.flatnonzero(new)
        length = np.add.reduceat(length, heads) if len(heads) else length
        return text[heads], start[heads], length, row[heads], offset[heads]


def _encoded(docs: DataFrame, tokens: list[bytes], pattern: str, end: int) -> DataFrame:
    """(doc_id, source, part, before, n, ids): before counts the ids of the source earlier in the task."""
    kept = docs.sparkSession.sparkContext.broadcast(tokens)
    wide = "<u2" if max(len(tokens), end + 1) <= 1 << 16 else "<u4"
    source = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")
    rows = docs.select("doc_id", "text", source)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import tiktoken

        encoding = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(kept.value)}, special_tokens={}
        )
        task = TaskContext.get().partitionId()
        so_far: dict[str, int] = {}
        names = ["doc_id", "source", "part", "before", "n", "ids"]
        for batch in batches:
            for part in slices(batch):
                before, sizes, ids = [], [], []
                for text, name in zip(raw_texts(part.column(1)), part.column(2).to_pylist(), strict=True):
                    found = encoding.encode_to_numpy(text.decode("utf-8", "replace"), disallowed_special=())
                    at = so_far.get(name, 0)
                    so_far[name] = at + len(found) + 1
                    before.append(at)
                    sizes.append(len(found) + 1)
                    ids.append(np.append(found, end).astype(wide).tobytes())
                arrays = [
                    part.column(0), part.column(2), pa.array([task] * len(ids), pa.int32()),
                    pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, source string, part int, before long, n long, ids binary")


def _queues(sizes: DataFrame, targets: dict[str, float] | None, queues: int):
    """({source: queue}, totals, shares) from (part, source, n); the last queue takes all other sources."""
    spare = queues - 1 - len(targets or {})
    if spare < 0:
        raise ValueError(f"more than {queues - 1} targets")
    totals = sizes.groupBy("source").agg(F.sum("n").alias("n"))
    asked = F.col("source").isin(list(targets)) if targets else F.lit(False)
    own = totals.where(~asked).orderBy(F.desc("n"), "source").limit(spare)  # bounded by ``queues``
    found = {r["source"]: r["n"] for r in own.collect()} | {r["source"]: r["n"] for r in totals.where(asked).collect()}
    everything = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rest = everything - sum(found.values())
    share = {s: (targets or {}).get(s, n / max(everything, 1)) for s, n in found.items()}
    names = sorted(found)
    return {s: i for i, s in enumerate(names)}, [*(found[s] for s in names), rest], [*(share[s] for s in names), rest / max(everything, 1)]


def pack(
    docs: DataFrame, path: str, pattern: str, targets: dict[str, float] | None = None,
    row: int = ROW, grain: int = GRAIN, end: int = END, queues: int = QUEUES,
) -> DataFrame:
    """(doc_id, source, start, length, doc_tokens, sequence_id, offset, ids): one row for each piece.

    ``path`` is a vocabulary file of a byte-level BPE, ``targets`` gives sources their part of
    each window (others get their own share). ``ids`` are little-endian unsigned 32-bit.
    """
    spark = docs.sparkSession
    tokens = vocabulary_ranks(path)
    wide = "<u2" if max(len(tokens), end + 1) <= 1 << 16 else "<u4"
    held = cut_lineage(_encoded(docs, tokens, pattern, end))
    sizes = cut_lineage(held.groupBy("part", "source").agg(F.sum("n").alias("n")))
    number, totals, shares = _queues(sizes, targets, queues)
    named = spark.createDataFrame([*number.items(), (None, len(number))], "source string, queue int")
    placed = sizes.join(F.broadcast(named), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(number))))
    earlier = W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a line a task
    inside = W.partitionBy("queue", "part").orderBy("source").rowsBetween(W.unboundedPreceding, -1)
    tasks = placed.groupBy("queue", "part").agg(F.sum("n").alias("n")).select(
        "queue", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("task_base")
    )
    bases = cut_lineage(
        placed.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(tasks, ["queue", "part"])
        .select("part", "source", "queue", (F.col("task_base") + F.col("inner")).alias("base"))
    )
    rows = held.join(bases, ["part", "source"]).select(
        "doc_id", "source", "n", "queue", (F.col("base") + F.col("before")).alias("at"), "ids"
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    schedule = Schedule(totals, shares, row, grain)  # three numbers a queue
    names = ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "ids"):
                n, queue, at = (part.column(i).to_numpy().astype(np.int64) for i in (2, 3, 4))
                text, start, length, sequence, offset = schedule.pieces(queue, at, n)
                ids = [np.frombuffer(x, wide).astype("<u4") for x in part.column(5).to_pylist()]
                cuts = zip(text.tolist(), start.tolist(), (start + length).tolist(), strict=True)
                picked = pa.array(text)
                arrays = [
                    part.column(0).take(picked), part.column(1).take(picked), pa.array(start), pa.array(length),
                    pa.array(n[text]), pa.array(sequence), pa.array(offset),
                    pa.array([ids[i][a:b].tobytes() for i, a, b in cuts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(
        cut,
        f"doc_id {kind}, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n, doc_ids, cu_seqlens, ids) of the packed rows; a row's pieces are at most its length."""
    listed = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    ids = F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x))
    ends = F.transform("p", lambda x: x["offset"] + x["length"])
    return pieces.groupBy("sequence_id").agg(listed.alias("p")).select(
        "sequence_id", F.array_max(ends).alias("n"), F.col("p.doc_id").alias("doc_ids"),
        F.concat(F.array(F.lit(0).cast("long")), ends).alias("cu_seqlens"), ids.alias("ids"),
    )


def shares_by_window(pieces: DataFrame) -> DataFrame:
    """(sequence_id, source, tokens, share): what each source has of each packed row."""
    whole = W.partitionBy("sequence_id")
    return (
        pieces.groupBy("sequence_id", "source").agg(F.sum("length").alias("tokens"))
        .withColumn("share", F.col("tokens") / F.sum("tokens").over(whole))
    )


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
