"""Turn texts into vectors: each distinct text once, then back to its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.functions.text import words
from themescope.operators.rows import join_repeated
from themescope.session import cut_lineage

Embedder = Callable[[list[str]], list[list[float]]]

DEFAULT_WIDTH = 3072
HASHED_WIDTH = 64
ATTEMPTS = 3


def distinct_texts(rows: DataFrame) -> DataFrame:
    """``(text, rep_id)``: one line per text; repeats combine before the shuffle."""
    return rows.groupBy("text").agg(F.min("row_id").alias("rep_id"))


def hashed_vectors(texts: DataFrame, width: int = HASHED_WIDTH) -> DataFrame:
    """Bag-of-words counts: each word adds one at the slot its md5 picks.

    Works on exploded words and built-in aggregates; only (text, slot) counts
    are shuffled, never the texts.
    """
    slot = (F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % width).cast("int")
    counts = (
        texts.select("rep_id", F.explode(words(F.col("text"))).alias("word"))
        .groupBy("rep_id", slot.alias("slot"))
        .agg(F.count(F.lit(1)).cast("float").alias("n"))
        .groupBy("rep_id")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "n"))).alias("_slots"))
    )
    zero = F.lit(0.0).cast("float")
    # slots in order: the zeros between two of them, then the count
    between = F.transform(
        "_slots",
        lambda e, i: F.concat(
            F.array_repeat(zero, e["slot"] - F.coalesce(F.get("_slots", i - 1)["slot"], F.lit(-1)) - 1), F.array(e["n"])
        ),
    )
    after = F.lit(width - 1) - F.element_at("_slots", -1)["slot"]
    vector = F.concat(F.flatten(between), F.array_repeat(zero, after))
    empty = F.array_repeat(F.lit(0.0).cast("float"), width)
    return texts.join(counts, "rep_id", "left").select(
        "rep_id",
        F.sha2("text", 256).alias("_digest"),
        F.when(F.col("_slots").isNull(), empty).otherwise(vector).alias("embedding"),
        F.lit(False).alias("failed"),
    )


def called_vectors(
    texts: DataFrame,
    embedder: Embedder,
    second: Embedder | None = None,
    calls: int | None = None,
    width: int | None = None,
    attempts: int = ATTEMPTS,
) -> DataFrame:
    """Vectors from a user's embedder, called once per distinct text.

    A batch that fails is retried text by text, with the second embedder from
    the second attempt on. A text that never succeeds gets a zero vector and
    ``failed``. Calls may be costly, so their results are written to the
    checkpoint folder at once; a lost executor does not repeat them later.
    """
    later = second or embedder

    def one(text: str):
        for attempt in range(attempts):
            try:
                return list((embedder if attempt == 0 else later)([text])[0])
            except Exception:
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts_in = batch["text"].tolist()
            try:
                vectors = [list(v) for v in embedder(texts_in)]
                if len(vectors) != len(texts_in):
                    raise ValueError("one vector per text is needed")
            except Exception:
                vectors = [one(t) for t in texts_in]
            yield pd.DataFrame(
                {
                    "rep_id": batch["rep_id"],
                    "_digest": batch["_digest"],
                    "embedding": pd.Series(vectors, index=batch.index, dtype=object),
                }
            )

    source = texts.select("rep_id", "text", F.sha2("text", 256).alias("_digest"))
    if calls:
        source = source.repartition(calls)
    raw = cut_lineage(
        source.mapInPandas(
            run, "rep_id bigint, _digest string, embedding array<float>"
        )
    )
    if width is None:
        width = raw.agg(F.max(F.size("embedding"))).first()[0]
        width = DEFAULT_WIDTH if width is None or width < 0 else width
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    return raw.withColumn("failed", F.col("embedding").isNull()).withColumn(
        "embedding", F.coalesce("embedding", zero)
    )


def embed_text(
    rows: DataFrame,
    embedder: Embedder | None = None,
    second: Embedder | None = None,
    calls: int | None = None,
    width: int | None = None,
    spread: int = 1_000_000,
) -> DataFrame:
    """Add ``embedding`` and ``failed`` to ``(row_id, text, ...)`` rows.

    Rows meet their vector on a text digest, so texts move once, to be made
    distinct. A text that fills a large part of the table is spread over tasks.
    """
    texts = distinct_texts(rows)
    if embedder is None:
        vectors = hashed_vectors(texts, width or HASHED_WIDTH)
    else:
        vectors = called_vectors(texts, embedder, second, calls, width)
    keyed = rows.withColumn("_digest", F.sha2("text", 256))
    return join_repeated(
        keyed, vectors.select("_digest", "embedding", "failed"), "_digest", spread=spread
    ).drop("_digest")
