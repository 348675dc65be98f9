"""Toxicity classifier with counterfactual regularisation.

Features are the different words of a text and their beginnings, hashed. The loss is the
logistic loss plus ``PENALTY`` times the squared change of a sentence's score when an identity
term in it is swapped for another of its group, plus a ridge. Every sentence of a labelled text
that holds a term (in the languages of IDENTITY) is swapped with up to SWAPS others for each of its terms;
a text's swaps share its weight. A term that only tends to stand in toxic texts thus gets no
weight of its own, and neutral mentions of a group are not rejected.

Learning uses a bounded sample of labelled rows: of each label about ``SAMPLE_ROWS`` rows of
least id hash, weighted to the shares of all labelled rows. Its features (a few MB) are
fitted on the driver. Scoring handles each whole text on its own, with no shuffle.

Defined results: null and empty texts get the score of the intercept; without labelled rows
of both kinds the score is the share of toxic labels (0 if there are none); repeated labels
of an id count as their largest; repeated rows score alike.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.llm.common import field, fold, lowest, one_label, per_text, raw_texts
from themescope.llm.license import words
from themescope.session import cut_lineage

SAMPLE_ROWS = 2500
BITS = 18
#: Bytes of a word's beginnings that are features too.
BEGINNINGS = (4, 5, 6)
#: Labelled texts in which a feature must stand.
LEAST_TEXTS = 5
PENALTY = 1.0
RIDGE = 2e-3
STEPS = 200
THRESHOLD = 0.3
#: Other terms that a term is swapped for, the next ones of its group.
SWAPS = 3
#: Identity terms of English, German, French and Spanish; those of a group stand for each other.
IDENTITY = (
    ("women", "men", "girls", "boys", "trans", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("she", "he"), ("her", "his"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "natives", "citizens"),
    ("blind", "deaf", "disabled", "old", "young"),
    ("frauen", "männer", "mädchen", "jungen"), ("frau", "mann"), ("sie", "er"), ("ihre", "seine"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell"),
    ("schwarze", "weiße", "asiatische", "europäische"),
    ("einwanderer", "flüchtlinge", "einheimische"), ("türken", "polen", "russen", "deutsche"),
    ("femmes", "hommes", "filles", "garçons"), ("femme", "homme", "fille", "garçon"), ("elle", "il"), ("elles", "ils"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes"), ("immigrés", "réfugiés", "autochtones"),
    ("mujeres", "hombres", "niñas", "niños"), ("mujer", "hombre", "niña", "niño"), ("ella", "él"), ("ellas", "ellos"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos"),
    ("negros", "blancas", "asiáticos", "latinos"), ("inmigrantes", "refugiados", "nativos"),
)
_SENTENCE = re.compile(rb"[.!?\n]+")


def _swaps() -> dict[bytes, list[bytes]]:
    """The terms that each term is swapped for."""
    out: dict[bytes, list[bytes]] = {}
    for group in IDENTITY:
        for i, term in enumerate(group):
            others = [group[(i + k) % len(group)].encode() for k in range(1, min(SWAPS, len(group) - 1) + 1)]
            out.setdefault(term.encode(), []).extend(others)
    return out


def counterfactuals(text: bytes, swaps: dict[bytes, list[bytes]]) -> list[tuple[set[bytes], set[bytes]]]:
    """Words of each sentence that holds an identity term, as they are and with the term swapped."""
    out = []
    for sentence in _SENTENCE.split(text):
        plain = set(words(sentence))
        for term in sorted(plain & swaps.keys()):
            out += [(plain, (plain - {term}) | {other}) for other in swaps[term]]
    return out


def word_features(word: bytes) -> list[int]:
    size = 1 << BITS
    cut = [b"%d:" % n + word[:n] for n in BEGINNINGS if len(word) >= n]
    return [zlib.crc32(b"w:" + word) % size] + [zlib.crc32(c) % size for c in cut]


def features(seen: set[bytes]) -> np.ndarray:
    return np.unique(np.array([f for w in seen for f in word_features(w)], np.int32))


class Model(NamedTuple):
    weights: np.ndarray  # float32, one a feature
    intercept: float

    def score(self, seen: set[bytes], memo: dict[bytes, float]) -> float:
        total = self.intercept
        for w in seen:
            v = memo.get(w)
            if v is None:
                if len(memo) > 500_000:
                    memo.clear()
                v = memo[w] = float(self.weights[word_features(w)].sum())
            total += v
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Pairs(NamedTuple):
    """Swapped sentences: the labelled text each is from, and its features before and after."""

    text: np.ndarray
    before: list[np.ndarray]
    after: list[np.ndarray]


def fit(rows: list[np.ndarray], pairs: Pairs, label: np.ndarray, weight: np.ndarray, penalty: float = PENALTY) -> Model:
    """Full-batch Adam on features that stand in LEAST_TEXTS texts and more."""
    texts = np.bincount(np.concatenate(rows) if rows else [], minlength=1 << BITS)
    kept = np.flatnonzero(texts >= min(LEAST_TEXTS, max(1, len(rows) // 4)))
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))

    def matrix(lists):
        at = [place[x][place[x] >= 0] for x in lists]
        sizes = [len(x) for x in at]
        return np.concatenate([*at, np.zeros(0, np.int32)]), np.repeat(np.arange(len(at), dtype=np.int32), sizes)

    # a feature enters by how unevenly it stands in the two kinds of texts, so common words count little
    toxic = np.bincount(np.concatenate([x for x, y in zip(rows, label, strict=True) if y == 1] or [kept[:0]]), minlength=1 << BITS)
    n1, n0 = int((label == 1).sum()), int((label == 0).sum())
    uneven = np.log((toxic + 1) / (n1 + 2)) - np.log((texts - toxic + 1) / (n0 + 2))
    uneven = uneven[kept]
    columns, row = matrix(rows)
    n = len(pairs.text)
    (old, old_row), (new, new_row) = matrix(pairs.before), matrix(pairs.after)
    share = penalty * weight[pairs.text] / np.bincount(pairs.text, minlength=len(rows))[pairs.text]
    w, b = np.zeros(len(kept)), float(np.log(max(weight[label == 1].sum(), 1e-9) / max(weight[label == 0].sum(), 1e-9)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    total = weight.sum()
    for step in range(1, STEPS + 1):
        scaled = w * uneven
        z = np.bincount(row, scaled[columns], len(rows)) + b
        p = _sigmoid(z)
        push = weight * (p - label) / total
        gradient = np.zeros(len(kept))
        bias = push.sum()
        if n:
            p, q = (_sigmoid(np.bincount(at, scaled[c], n) + b) for c, at in ((old, old_row), (new, new_row)))
            change = 2 * share * (p - q) / total
            up, down = change * p * (1 - p), change * q * (1 - q)
            gradient += np.bincount(old, up[old_row], len(kept)) - np.bincount(new, down[new_row], len(kept))
            bias += up.sum() - down.sum()
        gradient = (gradient + np.bincount(columns, push[row], len(kept))) * uneven + RIDGE * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        mb, vb = 0.9 * mb + 0.1 * bias, 0.99 * vb + 0.01 * bias**2
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        rate = 0.05 * (1 - step / (STEPS + 1))
        w -= rate * (m / fix) / (np.sqrt(v / fix2) + 1e-6)
        b -= rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-6)
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = w * uneven
    return Model(weights, b)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    known = one_label(labels, "toxic").where(fold("doc_id", 4) != 2).withColumn("__h", F.xxhash64("doc_id"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        share = 1.0 if counts.get(1) else 0.0
        return Model(np.zeros(1 << BITS, np.float32), 30.0 if share else -30.0)
    limits = lowest(known, "label", SAMPLE_ROWS)
    inside = F.lit(False)
    for label, limit in limits.items():
        inside = inside | ((F.col("label") == label) & (F.col("__h") <= limit))
    chosen = known.where(inside).select("doc_id", "label")  # about SAMPLE_ROWS a label
    swaps = _swaps()

    def made(batches):
        for batch in batches:
            plain, before, after = [], [], []
            for x in raw_texts(batch.column(2)):
                plain.append(features(set(words(x))).tobytes())
                pairs = counterfactuals(x, swaps)
                before.append([features(a).tobytes() for a, _ in pairs])
                after.append([features(b).tobytes() for _, b in pairs])
            kinds = [pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
            columns = [pa.array(c, k) for c, k in zip((plain, before, after), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns], names=["doc_id", "label", "plain", "before", "after"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
        .mapInArrow(made, f"doc_id {kind}, label int, plain binary, before array<binary>, after array<binary>")
        .groupBy("doc_id").agg(F.max("label").alias("label"), F.min(F.struct("plain", "before", "after")).alias("f"))
        .select("doc_id", "label", "f.*")
    )
    # in id order, one at a time; only the features are held
    label, plain, text, before, after = [], [], [], [], []
    for r in cut_lineage(found).orderBy("doc_id").toLocalIterator():
        text += [len(label)] * len(r["before"])
        label.append(float(r["label"]))
        plain.append(np.frombuffer(bytes(r["plain"]), np.int32))
        before += [np.frombuffer(bytes(x), np.int32) for x in r["before"]]
        after += [np.frombuffer(bytes(x), np.int32) for x in r["after"]]
    label = np.array(label)
    taken = {c: max(1, int((label == c).sum())) for c in (0, 1)}
    weight = np.where(label == 1, counts[1] / taken[1], counts[0] / taken[0])
    return fit(plain, Pairs(np.array(text, np.int64), before, after), label, weight)


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``tox_score`` of each row."""
    kept = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def start():
        model, memo = kept.value, {}
        return lambda texts: [[model.score(set(words(x)), memo) for x in texts]]

    return per_text(docs, list(keep), [field("tox_score", "double")], start)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``."""
    return score(docs, labels).select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without rows that score THRESHOLD and more."""
    return score(docs, labels, tuple(docs.columns)).where(F.col("tox_score") < THRESHOLD).select(*docs.columns)
