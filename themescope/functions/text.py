"""Text column expressions. All stay in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from themescope.functions.words import NEGATIVE, POSITIVE

# Every code point Python's str.strip() removes.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# A run of three or more ASCII letters with no letter, digit or underscore on
# either side. Possessive, so a failed word is given up at once.
WORD_PATTERN = r"(?<![\p{L}\p{N}_])[a-zA-Z]{3,}+(?![\p{L}\p{N}_])"


def strip(col: Column) -> Column:
    """Trim all Unicode white space, touching only the two ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return F.coalesce(F.length(strip(col)) == 0, F.lit(True))


def words(col: Column) -> Column:
    """Lower-cased plain words in order of appearance."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD_PATTERN), F.lit(0))


def _has_any(raw: Column, lowered: Column, tokens: list[str]) -> Column:
    # A token that contains another one can only match where that one does.
    needed = [t for t in dict.fromkeys(tokens) if not any(o != t and o in t for o in tokens)]
    tests = []
    for token in needed:
        tests.append(lowered.contains(token))
        if token != token.lower():  # a lower-case token cannot hit raw text only
            tests.append(raw.contains(token))
    return reduce(or_, tests, F.lit(False))


def sentiment(
    col: Column,
    negative: list[str] = NEGATIVE,
    positive: list[str] = POSITIVE,
    lowered: Column | None = None,
) -> Column:
    """-1 when any negative token occurs, else 1 when any positive, else 0."""
    low = F.lower(col) if lowered is None else lowered
    return (
        F.when(col.isNull(), 0)
        .when(_has_any(col, low, negative), -1)
        .when(_has_any(col, low, positive), 1)
        .otherwise(0)
    )


def clean_label(col: Column, max_words: int = 4) -> Column:
    """Drop quotes, trim, keep the first few words."""
    bare = strip(F.regexp_replace(col, "[\"']", ""))
    parts = F.split(bare, r"(?U)[\s\x1c-\x1f]+")
    return F.array_join(F.slice(parts, 1, max_words), " ")


def title_label(keywords: Column, cluster: Column) -> Column:
    """``Word / Word / Word`` from the best three keywords, else a numbered name."""
    numbered = F.concat(F.lit("Cluster "), (cluster + 1).cast("string"))
    joined = F.initcap(F.array_join(F.slice(keywords, 1, 3), " / "))
    return F.when(F.size(keywords) > 0, joined).otherwise(numbered)


def column_safe(col: Column) -> Column:
    return F.replace(col, F.lit(" "), F.lit("_"))


def file_safe(col: Column) -> Column:
    return F.regexp_replace(col, r"[^\p{L}\p{N}_\-]", "_")


def prompt_line(col: Column, width: int = 200) -> Column:
    return F.concat(F.lit("- "), F.left(col, F.lit(width)))


def parses_as_float(col: Column) -> Column:
    """Whether the text reads as a number under the usual scripting-language rules.

    Underscores are allowed between digits; a type suffix (``1d``) or a
    hexadecimal float, which a SQL cast would take, is refused.
    """
    text = strip(col)
    plain = F.regexp_replace(text, r"(?<=[0-9])_(?=[0-9])", "")
    refused = text.rlike(r"(?:[0-9.][dDfF]$)|(?:^[+-]?0[xX])")
    return plain.try_cast("double").isNotNull() & ~refused


def is_digits_only(col: Column) -> Column:
    """Digits once dots and dashes are taken out."""
    return strip(F.regexp_replace(col, r"[.\-]", "")).rlike(r"^\p{Nd}+$")


def distinct_names(col: Column) -> Column:
    """Names between commas, trimmed, blanks dropped, first-seen order, no repeats."""
    parts = F.transform(F.split(col, ","), strip)
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) > 0))


def fixed_digits(col: Column, digits: int) -> Column:
    """A number with that many decimals, exact halves to even, no grouping."""
    return F.replace(F.format_number(col, digits), F.lit(","), F.lit(""))
