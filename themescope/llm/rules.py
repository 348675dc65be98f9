"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a text whose signal lies above a cutoff. Labelled texts of good quality
are the holdout, by stratum (language). A third of them, chosen by hash, picks for each rule the
strictest cutoff worth trying, one that rejects at most ``ALPHA`` / number of rules of them (a
rule without one is off). The others certify: step s has every rule at its s-th cutoff from the lax
end, or at its strictest worth trying; with n texts of which the rules together reject x, an
exact binomial test must rule out a false-rejection rate above ``ALPHA``,
P[Bin(n, ALPHA) <= x] <= ``DELTA`` / number of strata (Bonferroni). Steps are tested in this fixed
order up to the first failure, which takes no correction for their number; the last certified
step is used. So with probability 1 - DELTA no stratum loses more than ALPHA of its good texts. A
step that rejects none is certified by about 144 good texts in each of four strata (216 with those
that pick). Where nothing can be certified the rules are off, also in strata without labels.

Signals are computed once, within each row, and written as a narrow table; counts per
stratum and cutoff add up before the shuffle, and the table of cutoffs has at most one row
a stratum and rule. Texts are never shuffled; only ids meet labels.

Defined results: null and empty texts have no words, fail the base rules and are not kept;
repeated labels of an id count once (good only if all say good); ids that are null have no
label; null languages are a stratum; repeated rows are judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themescope.session import cut_lineage

ALPHA = 0.03
DELTA = 0.05
#: Terms of the binomial sum that are added one by one; what lies beyond is bounded from above.
TERMS = 2000

SPACE = "[\\x20\\x09-\\x0D]+"
_BLANKS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Signals and the cutoffs that are tried.
RULES = {
    "symbol_share": [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2],
    "repeat_share": [0.02, 0.05, 0.08, 0.1, 0.12, 0.15],
    "dup_line_share": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4],
    "capital_share": [0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5],
    "word_length": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0],
    "word_shortness": [-4.0, -3.5, -3.0, -2.5, -2.0],
}


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def signals(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """``keep``, the counts of the base rules, and one column for each name in RULES."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, text.alias("__t"))
    rows = rows.withColumns(
        {
            "__w": F.filter(F.split("__t", SPACE), lambda w: w != ""),
            "__l": F.filter(F.split("__t", "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]"))),
        }
    )
    n = F.size("__w")
    windows = F.transform(
        F.sequence(F.lit(0), n - 5),
        lambda i: F.struct(F.xxhash64(*[F.get("__w", i + k) for k in range(5)]).alias("h"), i.alias("i")),
    )
    rows = rows.withColumn("__g", F.when(n >= 5, F.sort_array(windows)))
    # neighbours in hash order; equal hashes are windows of the same words
    same = F.filter(
        "__g",
        lambda x, j: (x["h"] == F.get("__g", j - 1)["h"]) | (x["h"] == F.get("__g", j + 1)["h"]),
    )
    rows = rows.withColumn("__d", F.sort_array(F.transform(same, lambda x: x["i"])))
    gaps = F.zip_with("__d", F.slice("__d", 2, F.greatest(F.size("__d"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(5)), F.lit(5)))
    rows = rows.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate("__t", _BLANKS, "")).cast("long"),
            "n_symbols": _removed(F.col("__t"), _SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"),
            "__lines": F.size("__l"),
            "__capitals": _removed(F.col("__t"), _CAPITALS),
        }
    )
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return rows.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_dup_lines") / F.greatest("__lines", F.lit(1))).alias("dup_line_share"),
        (F.col("__capitals") / chars).alias("capital_share"),
        (F.col("word_chars") / words).alias("word_length"),
        (-F.col("word_chars") / words).alias("word_shortness"),
    )


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, exact to double precision for n of 20 and more."""
    z = n.cast("double") + 1
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(x: Column, n: Column, a: float) -> Column:
    """P[Bin(n, a) <= x]; 1 where x is at or above the mean; never below the true value.

    Adds the terms from x down by their ratios, up to TERMS of them; the ratios only fall,
    so a geometric series bounds the rest.
    """
    log_first = _log_factorial(n) - _log_factorial(x) - _log_factorial(n - x) + x * math.log(a) + (n - x) * math.log1p(-a)
    odds = (1 - a) / a
    low = F.greatest(x - TERMS, F.lit(0))
    total = F.aggregate(
        F.sequence(x, low, F.lit(-1).cast("long")),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda acc, i: F.struct((acc["t"] * i * odds / (n - i + 1)).alias("t"), (acc["s"] + acc["t"]).alias("s")),
    )
    ratio = low * odds / (n - low + 1)
    rest = total["t"] / (1 - ratio)
    return F.when(x >= n * a, F.lit(1.0)).otherwise(F.least(F.exp(log_first) * (total["s"] + rest), F.lit(1.0)))


def _picks(doc_id: Column) -> Column:
    """Whether a labelled text is of the third that picks cutoffs."""
    return F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 8), 16, 10).cast("long") % 3 == 0


def _first_rejecting(rule: str) -> Column:
    """Which cutoff, from the lax end, is the first to reject a row."""
    return sum((F.when(F.col(rule) <= c, 1).otherwise(0) for c in RULES[rule]), F.lit(0))


def cutoffs(rows: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``(stratum, rule, cutoff)``: the cutoffs of the last certified step; rules that are off are absent.

    ``rows`` holds doc_id, the stratum and the signals; ``labels`` (doc_id, quality).
    """
    good = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    )
    first = [_first_rejecting(r).alias(f"f_{r}") for r in RULES]
    held = cut_lineage(
        rows.join(good, "doc_id").select(F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), _picks(F.col("doc_id")).alias("picks"), *first)
    )
    # the strictest cutoff of each rule worth trying, by its place from the lax end; -1 for none
    n = F.count("*")
    worth = [
        F.greatest(
            *[F.when(F.sum((F.col(f"f_{r}") <= k).cast("long")) <= alpha / len(RULES) * n, k).otherwise(-1) for k in range(len(cs))], F.lit(-1)
        ).alias(f"t_{r}")
        for r, cs in RULES.items()
    ]
    picked = held.where("picks").groupBy("stratum").agg(*worth)  # one row a stratum
    # the step from which on the rules reject a text
    step = F.least(*[F.when(F.col(f"f_{r}") <= F.col(f"t_{r}"), F.col(f"f_{r}")) for r in RULES], F.lit(len(max(RULES.values(), key=len))))
    counts = cut_lineage(
        held.where("NOT picks").join(picked, "stratum").groupBy("stratum", *[f"t_{r}" for r in RULES])
        .agg(n.alias("n"), *[F.sum((step <= k).cast("long")).alias(f"x_{k}") for k in range(len(max(RULES.values(), key=len)))])
    )
    level = delta / max(1, counts.count())
    certified = F.greatest(
        *[
            F.when(binomial_tail(F.col(f"x_{k}"), F.col("n"), alpha) <= level, k).otherwise(-1)
            for k in range(len(max(RULES.values(), key=len)))
        ]
    )  # rejections only grow with the steps: the last that passes comes before the first failure
    chosen = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.get(F.array(*map(F.lit, sorted(cs, reverse=True))), F.least("last", f"t_{r}")).alias("cutoff"))
            for r, cs in RULES.items()
        ]
    )
    return (
        counts.withColumn("last", certified).where("last >= 0").select("stratum", F.inline(chosen)).where("cutoff IS NOT NULL")
    )


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)``."""
    rows = cut_lineage(signals(docs))
    chosen = (
        cutoffs(rows, labels)
        .groupBy("stratum")
        .agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    )
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    passed = F.lit(True)
    for r in RULES:
        passed = passed & F.coalesce(F.col(r) <= F.col(f"cut_{r}"), F.lit(True))
    return (
        rows.withColumn("stratum", F.coalesce("lang", F.lit("")))
        .join(chosen, "stratum", "left")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            base.alias("base_failed"), (~base & passed).alias("kept"),
        )
    )
