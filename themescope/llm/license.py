"""Licence scan with a positional index of rare template words.

Templates are word lists. A word's weight is its inverse document frequency over the whole
corpus (counted in a first pass, for template words only). For each file and template the
highest-weighted template words that the file holds are looked up; each place of such a
word at template position j proposes the template at ``place - j``. Proposals that the
looked-up words agree on (same relative position) are aligned word by word, a few words apart at most, and stand if
enough of the template's weight agrees and every key phrase stands nearby.

A base phrase is a template whose words are all required, so its rarest word alone proposes
every place, and n_base counts them all.

Only the template words' counts are gathered (a few rows a task, summed before the shuffle);
the index has the size of the templates. Texts are never shuffled.

Defined results: null and empty texts have no words, null first and last word, empty labels
and score 0; with no documents all weights are equal; repeated rows are scanned again.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.llm.common import field, per_text, raw_texts, slices
from themescope.llm.license_texts import TEXTS

#: Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]


#: Notices by label, with the phrases that must stand in a match.
TEMPLATES = (
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files to deal in the software without restriction",
        ("permission is hereby granted", "free of charge"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
        ("redistribution and use", "source and binary forms"),
    ),
    Template(
        "gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")
    ),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", ("public domain", "cc0")),
    *(Template(*t) for t in TEXTS),
)
#: Template words that are looked up in a file, highest weight first.
LOOKUPS = 3
#: Share of a template's weight that must agree.
LEAST_SHARE = 0.6
#: Words ahead among which the next template word may stand.
DRIFT = 4

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Index:
    """Templates by word: ``postings[word]`` is a list of (template, position)."""

    def __init__(self, weights: dict[bytes, float]):
        entries = [(label, phrase, ()) for phrase, label in BASE.items()] + [tuple(t) for t in TEMPLATES]
        self.base = len(BASE)
        self.labels = [label for label, _, _ in entries]
        self.words = [words(text.encode()) for _, text, _ in entries]
        self.keys = [[words(k.encode()) for k in keys] for _, _, keys in entries]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, ws in enumerate(self.words):
            for j, w in enumerate(ws):
                self.postings.setdefault(w, []).append((t, j))
        self.weights = {w: weights.get(w, 1.0) for w in self.postings}
        self.order = sorted(self.postings, key=lambda w: (-self.weights[w], w))
        # without these words a phrase cannot stand, nor the key phrases of a template
        self.needed = [frozenset(ws if t < self.base else sum(self.keys[t], [])) for t, ws in enumerate(self.words)]
        self.total = [sum(self.weights[w] for w in ws) for ws in self.words]

    def scan(self, ws: list[bytes]):
        """(places of base phrases, base labels, labels, score) of a file's words."""
        known = self.postings
        found: dict[bytes, list[int]] = {}
        for i, w in enumerate(ws):
            if w in known:
                found.setdefault(w, []).append(i)
        possible = [self.possible(t, found) for t in range(len(self.words))]
        if not any(possible):
            return [], set(), set(), 0.0
        asked = [0] * len(self.words)
        votes: list[dict[int, int]] = [{} for _ in self.words]
        for w in self.order:  # the file's licence words, rarest first
            if w not in found:
                continue
            hit = set()
            for t, j in known[w]:
                if not possible[t]:
                    continue
                most = 1 if t < self.base else LOOKUPS
                if asked[t] >= most and t not in hit:
                    continue
                if t not in hit:
                    asked[t] += 1
                    hit.add(t)
                for i in found[w]:
                    if 0 <= i - j or t >= self.base:
                        votes[t][i - j] = votes[t].get(i - j, 0) + 1
        starts, base, labels, score = [], set(), set(), 0.0
        for t, at in enumerate(votes):
            if t < self.base:
                n = len(self.words[t])
                good = [i for i in at if ws[i : i + n] == self.words[t]]
                starts += good
                if good:
                    base.add(self.labels[t])
                    labels.add(self.labels[t])
                    score = 1.0
                continue
            agree = min(2, asked[t])
            for i, n in at.items():
                if n >= agree and (share := self.share(t, i, ws)) >= LEAST_SHARE and self.complete(t, i, ws):
                    labels.add(self.labels[t])
                    score = max(score, share)
        return starts, base, labels, score

    def possible(self, t: int, found: dict[bytes, list[int]]) -> bool:
        """Whether a file has the words that template ``t`` must have, and enough of its weight at all."""
        if not self.needed[t] <= found.keys():
            return False
        return t < self.base or sum(self.weights[w] for w in self.words[t] if w in found) >= LEAST_SHARE * self.total[t]

    def share(self, t: int, start: int, ws: list[bytes]) -> float:
        """Part of a template's weight that the file has from ``start`` on, in order, with few words between or missing."""
        total = same = 0.0
        at = max(0, start)
        for w in self.words[t]:
            total += self.weights[w]
            try:
                at = ws.index(w, at, at + DRIFT) + 1
            except ValueError:  # replaced or left out: the next word decides
                continue
            same += self.weights[w]
        return min(1.0, same / total)

    def complete(self, t: int, start: int, ws: list[bytes]) -> bool:
        n = len(self.words[t])
        near = ws[max(0, start - n) : start + 2 * n]
        return all(any(near[i : i + len(k)] == k for i in range(len(near))) for k in self.keys[t])


def _vocabulary() -> set[bytes]:
    texts = [*BASE, *(t.text for t in TEMPLATES)]
    return {w for text in texts for w in words(text.encode())}


def weights(docs: DataFrame) -> dict[bytes, float]:
    """ln(1 + N / (1 + df)) of each template word over all documents, as parts of the largest."""
    known = _vocabulary()

    def count(batches):
        total, seen = 0, dict.fromkeys(known, 0)
        for batch in batches:
            for part in slices(batch):
                for x in raw_texts(part.column(0)):
                    total += 1
                    for w in known.intersection(words(x)):
                        seen[w] += 1
        rows = [(b"", total), *seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows]), pa.array([n for _, n in rows])], names=["w", "n"])

    counts = docs.select("text").mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    df = {bytes(r.w): r.n for r in counts.collect()}  # one row a template word
    total = df.pop(b"", 0)
    idf = {w: math.log(1 + total / (1 + df.get(w, 0))) for w in known}
    top = max(idf.values()) or 1.0
    return {w: max(v / top, 1e-3) for w, v in idf.items()}


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    table = weights(docs)

    def start():
        index = Index(table)

        def work(texts):
            rows = []
            for x in texts:
                ws = words(x)
                starts, base, labels, score = index.scan(ws)
                first, last = (min(starts), max(starts)) if starts else (None, None)
                rows.append(
                    (len(ws), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), float(np.round(score, 6)))
                )
            return list(zip(*rows, strict=True))

        return work

    kinds = {
        "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string",
        "labels": "string", "score": "double",
    }
    return per_text(docs.select(*keep, "text"), list(keep), [field(n, k) for n, k in kinds.items()], start)
