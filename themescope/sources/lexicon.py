"""Sentiment word lists from JSON or typed text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from themescope.functions.text import strip
from themescope.functions.words import (
    FALLBACK_NEGATIVE,
    FALLBACK_POSITIVE,
    NEGATIVE,
    POSITIVE,
)


@dataclass(frozen=True)
class Lexicon:
    negative: list[str] = field(default_factory=lambda: list(NEGATIVE))
    positive: list[str] = field(default_factory=lambda: list(POSITIVE))


def read_lexicon(spark: SparkSession, path: str) -> Lexicon:
    """``sentiment_words.negative`` / ``.positive``; a broken file gives one word each.

    A lexicon is a configuration file: its words become constants of the plan.
    """
    try:
        raw = spark.read.option("multiLine", True).json(path)
        found = {}
        for side in ("negative", "positive"):
            words = raw.select(F.explode(f"sentiment_words.{side}").alias("w")) if _has(raw, side) else None
            rows = [] if words is None else words.select(strip(F.col("w")).alias("w")).collect()
            found[side] = [r["w"] for r in rows if r["w"]]
        if not _has(raw, "negative") and not _has(raw, "positive"):
            raise ValueError("no word lists")
        return Lexicon(found["negative"], found["positive"])
    except Exception:
        return Lexicon(list(FALLBACK_NEGATIVE), list(FALLBACK_POSITIVE))


def _has(raw, side: str) -> bool:
    if "sentiment_words" not in raw.columns:
        return False
    kind = raw.schema["sentiment_words"].dataType
    return hasattr(kind, "names") and side in kind.names


def split_words(col: Column) -> Column:
    """Words typed with commas or line breaks between them; trimmed, empties dropped."""
    parts = F.split(col, r"[,\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return F.filter(F.transform(parts, strip), lambda w: F.length(w) > 0)
