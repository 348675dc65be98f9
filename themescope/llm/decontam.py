"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and items are compared in lower case with runs of white space as one blank. If an item
of m characters stands in a text with at most k edits, at least ``m - q + 1 - k q`` of its
q-grams stand there too, on diagonals (place in the text minus place in the item) that
differ by at most k. So shared q-grams are counted for each item in overlapping bands of
diagonals; bands that reach the bound are aligned, banded, and stay if k edits suffice.

Items that are equal in this form are searched once; a join by digest gives their matches to each
of them. The different ones are read in groups of at most about ``GROUP_CHARS`` characters; each
group's q-grams are broadcast and searched in one pass over the texts. So the broadcast has a
fixed bound and a larger benchmark takes more passes. Pairs of a place in a text and a posting are
counted ``PAIRS`` at a time, so a q-gram common to many items takes more steps, not more
memory. Texts are never shuffled.

Defined results: null and empty texts match nothing; null and blank items are skipped; equal
items match separately; items shorter than q must stand exactly; a text that holds an item
several times reports each place: of places that overlap, the one of least edits (then the
first); repeated rows are searched again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themescope.llm.common import per_text, raw_texts
from themescope.llm.rolling import BASE
from themescope.session import cut_lineage

Q = 8
#: Edits allowed, as a share of an item's characters.
EDITS = 0.1
GROUP_CHARS = 4_000_000
#: Pairs of a place and a posting that are counted at once; those of one q-gram of the text stay together.
PAIRS = 2_000_000
_BITS = 21
_ODD = np.uint64(0xD6E8FEB86659FD93)

#: Characters of normal text that are searched at once (a longer text is searched alone).
_AT_ONCE = 1 << 18
_MATCH = [("digest", T.StringType()), ("start", T.IntegerType()), ("edits", T.IntegerType())]
_MATCHES = T.StructField("matches", T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _MATCH])))


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    h, step, power = codes.astype(np.uint64) + np.uint64(1), 1, int(BASE)
    while step < Q:
        h = h[:-step] * np.uint64(power) + h[step:] if len(h) > step else h[:0]
        step, power = step * 2, power * power % 2**64
    return h * _ODD


def budget(m: int) -> int:
    """Edits allowed in an item of m characters; few enough that the lemma asks for a q-gram."""
    return max(0, min(int(m * EDITS), (m - Q) // Q))


def align(item: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int] | None:
    """(edits, end) of the best place of ``item`` in ``text`` with at most k edits.

    Only cells whose diagonal can matter are filled: text is a window a little longer than
    the item, so a row holds len(text) - len(item) + 2 k + 1 cells.
    """
    m, n = len(item), len(text)
    low, high = -k, n - m + k  # diagonals: text place minus item place
    width = high - low + 1
    if width < 1:
        return None
    far = m + n
    cell = np.arange(width)
    place = low + cell  # text characters used before the first item character
    row = np.where((place >= 0) & (place <= n), 0, far)
    # the text with k places before it and behind it; what a step to each place costs, what a stay after it
    padded = np.concatenate([np.zeros(k, np.uint32), text, np.zeros(k + 1, np.uint32)])
    wrong, stay = np.zeros(n + 2 * k + 1, np.int64), np.ones(n + 2 * k + 2, np.int64)
    wrong[:k] = wrong[k + n :] = stay[:k] = stay[k + n + 1 :] = far
    for i, code in enumerate(item):
        step = row + wrong[i : i + width]
        step += padded[i : i + width] != code
        skip = row[1:] + stay[i + 1 : i + width]  # an item character without a partner
        np.minimum(step[:-1], skip, out=step[:-1])
        step -= cell
        row = np.minimum.accumulate(step)  # text characters without a partner
        row += cell
        if i % 4 == 3 and row.min() > k:  # it never falls
            return None
    best = int(row.argmin())
    return (int(row[best]), int(place[best] + m)) if row[best] <= k else None


class Index:
    def __init__(self, items: list[str]):
        self.items = items
        self.codes = [_codes(x) for x in items]
        size = np.array([len(x) for x in items], np.int64)
        self.size = size
        self.edits = np.array([budget(int(m)) for m in size], np.int64)
        self.least = size - Q + 1 - self.edits * Q
        self.width = 2 * (self.edits + 1)
        grams = [_grams(c) for c in self.codes]
        h = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.place = h[order], item[order], place[order]
        self.known = np.zeros(1 << _BITS, bool)
        self.known[(self.h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.short = [i for i, m in enumerate(size.tolist()) if m < Q]

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(item, start, edits) of each place of each item in each text."""
        texts = [normal(t) for t in texts]
        out: list[list] = [[] for _ in texts]
        for t, text in enumerate(texts):
            out[t] = [(i, at, 0) for i in self.short for at in _places(text, self.items[i])]
        first, size = 0, 0
        for t, text in enumerate(texts):
            size += len(text)
            if size >= _AT_ONCE or t == len(texts) - 1:
                for k, found in self._together(texts[first : t + 1]).items():
                    for i, places in sorted(found.items()):
                        out[first + k] += [(i, at, edits) for edits, at in self._apart(places, int(self.size[i]))]
                first, size = t + 1, 0
        return out

    @staticmethod
    def _apart(places: set[tuple[int, int]], m: int) -> list[tuple[int, int]]:
        """(edits, start) of places that do not overlap, the best first chosen; in their order."""
        kept: list[tuple[int, int]] = []
        for edits, at in sorted(places):
            if all(abs(at - other) >= m for _, other in kept):
                kept.append((edits, at))
        return sorted(kept, key=lambda x: x[1])

    def _counted(self, pair: np.ndarray, diagonal: np.ndarray, item: np.ndarray, shift: int):
        """(pair, band, count) of one family of bands."""
        w = self.width[item]
        band = (diagonal + shift * (w // 2)) // w
        span = int(band.max()) + 1
        if (int(pair.max()) + 1) * span >= 2**63:  # one number does not hold both
            order = np.lexsort((band, pair))
            p, b = pair[order], band[order]
            new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (b[1:] != b[:-1])))
            return p[new], b[new], np.diff(np.append(new, len(p)))
        both = np.sort(pair * span + band)
        new = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        return *np.divmod(both[new], span), np.diff(np.append(new, len(both)))

    def _together(self, texts: list[str]) -> dict[int, dict[int, set[tuple[int, int]]]]:
        """(edits, start) of places by text and item; places of one region may overlap."""
        codes = _codes("\0".join(texts))
        sizes = np.array([len(x) + 1 for x in texts])
        starts = np.cumsum(sizes) - sizes
        h = _grams(codes)
        at = np.flatnonzero(self.known[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        left = np.searchsorted(self.h, h[at], "left")
        n = np.searchsorted(self.h, h[at], "right") - left
        at, left, n = at[n > 0], left[n > 0], n[n > 0]
        if not len(at):
            return {}
        most = int(self.size.max())
        ends = np.cumsum(n)
        parts: list[list[tuple]] = [[], []]
        first = 0
        while first < len(at):  # so many places that their postings are about PAIRS
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
            a, m = at[first:last], n[first:last]
            posting = np.repeat(left[first:last] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            item = self.item[posting]
            text = np.searchsorted(starts, a, "right") - 1
            diagonal = np.repeat(a - starts[text], m) - self.place[posting] + most
            pair = np.repeat(text, m) * len(self.items) + item
            for shift in (0, 1):  # two families of bands, half a band apart
                parts[shift].append(self._counted(pair, diagonal, item, shift))
            first = last
        found: dict[int, dict[int, set[tuple[int, int]]]] = {}
        for shift, counted in enumerate(parts):
            p, b, count = (np.concatenate(c) for c in zip(*counted, strict=True))
            if len(counted) > 1:  # bands that lie in several parts
                order = np.lexsort((b, p))
                p, b, count = p[order], b[order], count[order]
                new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (b[1:] != b[:-1])))
                p, b, count = p[new], b[new], np.add.reduceat(count, new)
            good = count >= self.least[p % len(self.items)]
            for pk, bk in zip(p[good].tolist(), b[good].tolist(), strict=True):
                t, i = divmod(pk, len(self.items))
                w, k, m = int(self.width[i]), int(self.edits[i]), int(self.size[i])
                start = bk * w - shift * (w // 2) - most
                lo, hi = max(0, start - k), min(len(texts[t]), start + w + m + k)
                exact = texts[t].find(self.items[i], lo, hi)
                got = (0, exact) if exact >= 0 else None
                if got is None and k and (best := align(self.codes[i], _codes(texts[t][lo:hi]), k)):
                    got = (best[0], max(0, lo + best[1] - m))
                here = found.setdefault(t, {})
                if got:
                    here.setdefault(i, set()).add(got)
        return found


def _places(text: str, item: str) -> list[int]:
    """Places of a short item that do not overlap, from the left."""
    out, at = [], text.find(item)
    while at >= 0:
        out.append(at)
        at = text.find(item, at + len(item))
    return out


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def _different(benchmark: DataFrame) -> DataFrame:
    """``(item_id, digest, item)``: the normal form of each item that has one."""

    def run(batches):
        for batch in batches:
            texts = [normal(t.decode("utf-8", "replace")) for t in raw_texts(batch.column(1))]
            arrays = [batch.column(0), pa.array([_digest(t) for t in texts]), pa.array(texts)]
            yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "digest", "item"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    made = benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, digest string, item string")
    return cut_lineage(made.where("item <> ''"))


def _groups(items: DataFrame) -> Iterator[list[str]]:
    """The different normal texts in groups of bounded size; one group is on the driver at a time, by digest."""
    once = cut_lineage(items.groupBy("digest").agg(F.min("item").alias("item")))
    total = once.agg(F.sum(F.length("item"))).first()[0] or 0
    n = -(-total // GROUP_CHARS)
    for g in range(n):
        part = once.where(F.pmod(F.xxhash64("digest"), F.lit(n)) == g)
        yield sorted(r["item"] for r in part.select("item").collect())


def _searched(docs: DataFrame, keep: list[str], items: list[str]) -> DataFrame:
    kept = docs.sparkSession.sparkContext.broadcast(items)

    def start():
        index = Index(kept.value)
        names = [_digest(x) for x in kept.value]

        def work(texts):
            found = index.search([t.decode("utf-8", "replace") for t in texts])
            return [[[{"digest": names[i], "start": at, "edits": n} for i, at, n in row] for row in found]]

        return work

    return per_text(docs, keep, [_MATCHES], start)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, start, edits)``: a row for each place of an item in a text; start in the normal form."""
    items = _different(benchmark)
    parts = []
    for group in _groups(items):
        rows = _searched(docs.select("doc_id", "text"), ["doc_id"], group)
        parts.append(rows.select("doc_id", F.inline("matches")))
    if not parts:
        return docs.where("false").select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("edits"))
    found = reduce(DataFrame.unionByName, parts)
    return found.join(items.select("digest", "item_id"), "digest").select("doc_id", "item_id", "start", "edits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without rows in which an item stands."""
    out = docs
    for group in _groups(_different(benchmark)):
        out = _searched(out, out.columns, group).where(F.size("matches") == 0).drop("matches")
    return out
