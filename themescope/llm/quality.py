"""Quality classifier: ridge on random Fourier features of document statistics, calibrated.

Each text becomes about twenty statistics (lengths, shares of kinds of characters, repeats).
Random Fourier features ``sqrt(2/D) cos(Wx + b)`` approximate a Gaussian kernel over the
standardised statistics. The normal equations ``Z'Z`` and ``Z'y`` are sums over rows: each
partition adds up its own and sends one matrix of fixed size, partial matrices add up before
and in the shuffle, and the driver solves one D x D system. Isotonic regression over
``BINS`` bins of ridge scores turns scores into probabilities.

All labelled rows outside the held-out fold are used. Statistics are computed once and
written as a narrow table; texts are never shuffled.

Defined results: null and empty texts have statistics of zero and are scored like any other;
without labelled rows the score is 0; repeated labels of an id count as their largest;
repeated rows score alike; null ids have no label.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.llm.common import field, fold, one_label, per_text
from themescope.session import cut_lineage

FEATURES = 128
WIDTH = 2.5
RIDGE = 1e-3
BINS = 1000
THRESHOLD = 0.7

_KINDS = np.zeros(256, np.uint8)  # 1 lower, 2 capital, 3 digit, 4 blank, 5 symbol, 6 ends of sentences, 7 other marks, 0 beyond ASCII
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58] = 1, 2, 3
_KINDS[33:48] = _KINDS[58:65] = _KINDS[91:97] = _KINDS[123:127] = 7
_KINDS[list(b" \t\n\x0b\f\r")] = 4
_KINDS[list(b"#*$%&|<>")] = 5
_KINDS[list(b".!?")] = 6
N_STATISTICS = 20


def statistics(text: bytes) -> list[float]:
    """Statistics of a whole text."""
    n = max(1, len(text))
    kinds = np.bincount(_KINDS[np.frombuffer(text, np.uint8)], minlength=8) / n
    ws = text.split()
    n_words = max(1, len(ws))
    different = Counter(ws)
    most = different.most_common(1)[0][1] if different else 0
    runs = sum(map(bytes.__eq__, ws, ws[1:]))
    pairs = len(set(zip(ws, ws[1:], strict=False)))
    triples = len(set(zip(ws, ws[1:], ws[2:], strict=False)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    return [
        np.log1p(len(ws)), np.log1p(len(lines)), len(text) / n_words / 10, *kinds.tolist(),
        len(different) / n_words, most / n_words, runs / n_words, pairs / n_words, triples / n_words,
        1 - len(set(lines)) / n_lines if lines else 0.0, ends / n_lines, text.count(b"|") / n_words, text.count(b"!") / n_words,
    ]


class Scale(NamedTuple):
    mean: np.ndarray
    spread: np.ndarray


class Model(NamedTuple):
    scale: Scale
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray


def fourier(x: np.ndarray, scale: Scale) -> np.ndarray:
    """Random Fourier features (and a constant) of rows of statistics."""
    draw = np.random.default_rng(7)
    w = draw.normal(0, 1 / WIDTH, (N_STATISTICS, FEATURES))
    b = draw.uniform(0, 2 * np.pi, FEATURES)
    z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - scale.mean) / scale.spread, -8, 8) @ w + b)
    return np.column_stack([z, np.ones(len(z))])


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Nearest non-decreasing values, by pooling neighbours that violate the order."""
    means, weights, sizes = [], [], []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        means.append(v)
        weights.append(w)
        sizes.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            w = weights[-2] + weights[-1]
            means[-2] = (means[-2] * weights[-2] + means[-1] * weights[-1]) / w
            weights[-2] = w
            sizes[-2] += sizes[-1]
            del means[-1], weights[-1], sizes[-1]
    return np.repeat(means, sizes)


def _vectors(batch, at: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)


def learn(rows: DataFrame) -> Model | None:
    """Fit on ``(label, x)``; None where there are no rows."""
    moments = rows.select(
        F.count("*").alias("n"),
        *[f(F.get("x", i) ** p).alias(f"m{p}_{i}") for i in range(N_STATISTICS) for p, f in ((1, F.avg), (2, F.avg))],
    ).first()
    if not moments["n"]:
        return None
    mean = np.array([moments[f"m1_{i}"] for i in range(N_STATISTICS)])
    square = np.array([moments[f"m2_{i}"] for i in range(N_STATISTICS)])
    spread = np.sqrt(np.maximum(square - mean**2, 0))
    scale = Scale(mean, np.where(spread < 1e-9, 1.0, spread))

    def normal(batches):
        total, seen = np.zeros((FEATURES + 1, FEATURES + 2)), False
        for batch in batches:
            z = fourier(_vectors(batch, 1), scale)
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            total += np.column_stack([z.T @ z, z.T @ y])
            seen = True
        if seen:
            i, j = np.divmod(np.arange(total.size, dtype=np.int32), FEATURES + 2)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "v"])

    sums = rows.select("label", "x").mapInArrow(normal, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    system = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in sums.collect():  # a fixed number of rows
        system[r["i"], r["j"]] = r["v"]
    ridge = RIDGE * moments["n"] * np.eye(FEATURES + 1)
    ridge[-1, -1] = 0
    weights = np.linalg.solve(system[:, :-1] + ridge + 1e-9 * np.eye(FEATURES + 1), system[:, -1])

    def binned(batches):
        n, s = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            value = fourier(_vectors(batch, 1), scale) @ weights
            k = _bins(value)
            n += np.bincount(k, minlength=BINS)
            s += np.bincount(k, batch.column(0).to_numpy(zero_copy_only=False).astype(float), BINS)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n[k]), pa.array(s[k])], names=["k", "n", "s"])

    table = rows.select("label", "x").mapInArrow(binned, "k int, n double, s double")
    bins = table.groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("k").collect()  # at most BINS rows
    count = np.array([r["n"] for r in bins])
    values = isotonic(np.array([r["s"] for r in bins]) / count, count)
    knots = (np.array([r["k"] for r in bins]) + 0.5) / BINS * 2 - 0.5
    return Model(scale, weights, knots, values)


def _bins(value: np.ndarray) -> np.ndarray:
    """Bins of equal width over ridge scores from -0.5 to 1.5."""
    return np.clip(((value + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``."""

    def start():
        return lambda texts: [[statistics(x) for x in texts]]

    rows = cut_lineage(per_text(docs.select("doc_id", "text"), ["doc_id"], [field("x", "doubles")], start))
    known = one_label(labels, "quality").where(fold("doc_id", 4) != 2)
    model = learn(cut_lineage(rows.join(known, "doc_id").select("label", "x")))

    def scored(batches):
        for batch in batches:
            if model is None:
                out = np.zeros(batch.num_rows)
            else:
                out = np.interp(fourier(_vectors(batch, 1), model.scale) @ model.weights, model.knots, model.values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(out, 0, 1))], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(scored, f"doc_id {kind}, score double")
    return out.select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
