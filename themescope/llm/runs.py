"""Periodic runs of words: stretches that repeat one root at least four times.

Each text is handled whole within its task; nothing is shuffled.

1. Sieve. In a run of exponent 4 and 6 words or more, every three consecutive words stand at
   least three times. Counts of hashed word triples (a bucket never counts too few) leave the
   stretches in which all triples are that frequent; the rest can hold no run. The sieve is
   applied again within each stretch as long as it removes something.
2. Baier grouping, the first phase of the suffix sorter of that name: places are grouped by
   the longest Lyndon word found so far; the highest group is final, is taken out, and
   lengthens the words of the places before it, which move to groups of their own. It gives
   the Lyndon array directly, once for an order of the words and once for its reverse.
   Neighbouring places of one final group are copies of a Lyndon root.
3. Every run holds its root three times in a row under one of the two orders. Such chains are
   extended by their longest common extensions to both sides; the result is the run.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes (bytes that are not UTF-8
stay as they are); null and empty texts have no words, no runs and the digest of ''; repeated
rows are reported again; ids may be of any type, a null id stays null. Other columns are never
read, an empty table gives no rows. Memory is bounded by the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themescope.llm.common import field, raw_texts, slices
from themescope.llm.rolling import mix

#: A run has at least this many copies of its root, and this many words.
COPIES = 4
LEAST = 6


def lyndon_chains(word: list[int]) -> list[tuple[int, int, int, int]]:
    """(group, first place, root length, copies) of all chains of equal Lyndon words.

    ``word`` holds numbers whose order is the order of the words; chains of one group hold
    the same root. Each place is in one chain, so copies times root length over the chains
    of one copy and more is the Lyndon array.
    """
    n = len(word)
    values = sorted(set(word))
    number = {v: g for g, v in enumerate(values)}
    group = [number[v] for v in word]
    members: list[list[int]] = [[] for _ in values]
    for place, g in enumerate(group):
        members[g].append(place)
    lower, higher = list(range(-1, len(values) - 1)), [*range(1, len(values)), -1]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # among places not taken out
    chains = []
    top = len(values) - 1
    while top >= 0:
        moved: dict[int, list[int]] = {}
        for head in members[top]:
            if group[head] != top or (before[head] >= 0 and group[before[head]] == top):
                continue  # has moved on, or stands within a chain
            end, copies = after[head], 1
            while end < n and group[end] == top:
                end, copies = after[end], copies + 1
            chains.append((top, head, after[head] - head, copies))
            left = before[head]
            if end < n:
                before[end] = left
            if left >= 0:
                after[left] = end
                moved.setdefault(copies, []).append(left)
        for copies in sorted(moved, reverse=True):  # fewer copies end up lower, all above the old group
            fresh: dict[int, int] = {}
            for place in moved[copies]:
                old = group[place]
                new = fresh.get(old)
                if new is None:
                    new = fresh[old] = len(members)
                    members.append([])
                    over = higher[old]
                    lower.append(old)
                    higher.append(over)
                    higher[old] = lower[over] = new  # the group in work is above every other
                group[place] = new
                members[new].append(place)
        top = lower[top]
    return chains


def stretches(word: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the stretches of ``word`` outside of which no run has a word.

    ``part`` numbers the texts; no stretch reaches into another text.
    """
    place = np.arange(len(word))
    while len(word) >= LEAST:
        a, b, c = (word[i : len(word) - 2 + i].astype(np.uint64) for i in range(3))
        one = part[:-2] == part[2:]
        with np.errstate(over="ignore"):
            key = mix(a + mix(b + mix(c + mix(part[:-2].astype(np.uint64)))))
        key = (key & np.uint64((1 << (4 * len(word)).bit_length()) - 1)).astype(np.int64)
        often = one & (np.bincount(key[one], minlength=1)[np.where(one, key, 0)] >= COPIES - 1) if one.any() else one
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (often * (part[:-2] + 1)), [0]])))
        # edges between different texts end one stretch and begin the next
        first, end = edge[:-1], edge[1:]
        held = often[first] & (end - first >= LEAST - 2) if len(edge) else np.zeros(0, bool)
        first, end = first[held], end[held] + 2
        sizes = end - first
        if sizes.sum() > 0.9 * len(word):
            return list(zip(place[first].tolist(), (place[end - 1] + 1).tolist(), strict=True))
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        word, place, part = word[at], place[at], np.repeat(np.arange(len(first)), sizes)
    return []


def runs_between(word: list[int], low: int, high: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``word`` whose words are all from low to high."""
    found = set()
    part = word[low:high]
    for order in (part, [-w for w in part]):
        for _, head, period, copies in lyndon_chains(order):
            if copies < COPIES - 1:
                continue
            start, end = low + head, low + head + period * copies
            while start > low and word[start - 1] == word[start - 1 + period]:
                start -= 1
            while end < high and word[end] == word[end - period]:
                end += 1
            if end - start >= max(LEAST, COPIES * period):
                found.add((start, end - start, period))
    return found


def find(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each text, given as its words, the sorted (start, length, period) of its runs."""
    names: dict[bytes, int] = {}
    flat = [names.setdefault(w, len(names)) for words in texts for w in words]
    sizes = np.array([len(words) for words in texts], np.int64)
    ends = np.cumsum(sizes)
    found: list[set] = [set() for _ in texts]
    for low, high in stretches(np.array(flat, np.int64), np.repeat(np.arange(len(texts)), sizes)):
        text = int(np.searchsorted(ends, low, side="right"))
        begin = int(ends[text] - sizes[text])
        found[text] |= {(start - begin, length, period) for start, length, period in runs_between(flat, low, high)}
    return [sorted(x, key=lambda run: (run[0], run[2])) for x in found]


def repeat_by_id(words: list[bytes], h: int) -> list[bytes]:
    """Words whose tail repeats one root, for every tenth hash ``h`` of an id."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    root = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (root * (-(-(n - a) // len(root))))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run holds after its first copy of the root."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _per_document(docs: DataFrame, fields: list[T.StructField], made: Callable, planted: bool) -> DataFrame:
    """One row a document: ``made(words, runs)`` gives its values for ``fields``."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h")
    rows = docs.select("doc_id", "text").select("doc_id", "text", h)
    schema = T.StructType([rows.schema["doc_id"], *fields])
    names = [f.name for f in schema]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for part in slices(batch):
                texts = [text.split() for text in raw_texts(part.column(1))]
                if planted:
                    texts = [repeat_by_id(w, x) for w, x in zip(texts, part.column(2).to_pylist(), strict=True)]
                rows = [made(words, runs) for words, runs in zip(texts, find(texts), strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return rows.mapInArrow(run, schema)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period): one row for each run of each text."""

    def made(words, runs):
        return ([{"start": s, "length": n, "period": p} for s, n, p in runs],)

    kind = T._parse_datatype_string("array<struct<start: bigint, length: bigint, period: bigint>>")
    listed = _per_document(docs, [T.StructField("runs", kind)], made, False)
    return listed.select("doc_id", F.inline("runs"))


def collapse(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words that are left when each run keeps one copy of its root."""

    def made(words, runs):
        return (b" ".join(collapsed(words, runs)),)

    out = _per_document(docs, [field("text", "binary")], made, False)
    return out.select("doc_id", F.col("text").cast("string").alias("text"))


def digests(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Number of runs, the longest one and digests of all runs and of the collapsed text.

    ``planted`` first repeats a part of the text in every tenth document, chosen by its id.
    """
    fields = [field(n, "long") for n in ("n_runs", "start", "length", "period", "exponent_milli")]
    fields += [field("runs_sha256", "string"), field("collapsed_sha256", "string")]

    def made(words, runs):
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        exponent = 1000 * length // period if runs else None
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
        text = b" ".join(collapsed(words, runs))
        shas = (hashlib.sha256(lines).hexdigest(), hashlib.sha256(text).hexdigest())
        return (len(runs), start, length, period, exponent, *shas)

    return _per_document(docs, fields, made, planted)
