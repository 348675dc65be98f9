"""Statistical column expressions: normal and chi-square tails, two-proportion test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two-sided 95 % point of the standard normal. Fixed value.
Z_95 = 1.959963984540054

# Terms of the incomplete gamma function; enough for shapes up to LARGE_DOF / 2.
_TERMS = 400
#: Degrees of freedom from which the cube-root normal approximation is used (error below 1e-5).
LARGE_DOF = 5_000


def _log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function for a > 0: Stirling's series eight places up."""
    z = a + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z)
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(a + i)
    return series + 1 / (1260 * z * z * z * z * z) - shift


def gamma_tail(a: Column, x: Column) -> Column:
    """Upper regularised incomplete gamma function for a > 0, x > 0, in a fixed number of steps.

    A power series below a + 1, a continued fraction above, so that small tails
    keep their digits.
    """
    log_front = a * F.log(x) - x - _log_gamma(a)
    steps = F.sequence(F.lit(1), F.lit(_TERMS))
    start = F.struct(a.alias("a"), x.alias("x"), (1 / a).alias("term"), (1 / a).alias("total"))
    series = F.aggregate(
        steps,
        start,
        lambda s, i: F.struct(
            s["a"].alias("a"),
            s["x"].alias("x"),
            (s["term"] * s["x"] / (s["a"] + i)).alias("term"),
            (s["total"] + s["term"] * s["x"] / (s["a"] + i)).alias("total"),
        ),
        lambda s: s["total"],
    )

    def fraction(s: Column, i: Column) -> Column:
        # one step of Lentz's method; h holds the value so far
        n = i.cast("double")
        top, bottom = -n * (n - s["a"]), s["b"] + 2
        d = 1 / (top * s["d"] + bottom)
        c = bottom + top / s["c"]
        return F.struct(
            s["a"].alias("a"), bottom.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h")
        )

    b = x + 1 - a
    first = F.struct(
        a.alias("a"), b.alias("b"), F.lit(1e300).alias("c"), (1 / b).alias("d"), (1 / b).alias("h")
    )
    continued = F.aggregate(steps, first, fraction, lambda s: s["h"])
    front = F.exp(log_front)
    return F.when(x < a + 1, 1 - front * series).otherwise(front * continued)


def two_sided_p(z: Column) -> Column:
    """2 * (1 - cdf(|z|)), with its digits kept far out; 1 at z = 0."""
    return chi_square_p(z * z, F.lit(1))


def chi_square_p(x: Column, dof: Column) -> Column:
    """Upper tail of chi-square; the work does not depend on ``dof``.

    Give it plain columns: the terms refer to them many times.
    """
    shape = dof.cast("double") / 2
    exact = gamma_tail(shape, x / 2)
    n = dof.cast("double")
    spread = 2 / (9 * n)
    z = (F.cbrt(x / n) - (1 - spread)) / F.sqrt(spread)
    far = gamma_tail(F.lit(0.5), z * z / 2) / 2
    large = F.when(z == 0, F.lit(0.5)).when(z > 0, far).otherwise(1 - far)
    tail = F.when(n > LARGE_DOF, large).otherwise(exact)
    return F.when((dof <= 0) | (x <= 0), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))


def with_two_proportion_test(
    df: DataFrame, n1: int, x1: Column, n2: int, x2: Column, names: tuple[str, str, str, str]
) -> DataFrame:
    """Add pooled z, two-sided p and the 95 % interval in percent points.

    Every result is null when a group is empty or the pooled error is zero. The
    steps are separate columns, so that none is spelled out twice in the plan.
    """
    z, p, low, high = names
    x1, x2 = x1.cast("double"), x2.cast("double")
    if n1 <= 0 or n2 <= 0:
        return df.withColumns({name: F.lit(None).cast("double") for name in names})
    pooled = (x1 + x2) / float(n1 + n2)
    spread = 1 / n1 + 1 / n2
    out = df.withColumns({"_gap": x1 / float(n1) - x2 / float(n2), "_pooled": pooled})
    error = F.sqrt(F.col("_pooled") * (1 - F.col("_pooled")) * spread)
    out = out.withColumn("_error", F.nullif(error, F.lit(0.0)))
    out = out.withColumn(z, F.col("_gap") / F.col("_error"))
    margin = Z_95 * F.col("_error")
    out = out.withColumns(
        {
            p: F.when(F.col(z).isNotNull(), two_sided_p(F.col(z))),
            low: (F.col("_gap") - margin) * 100,
            high: (F.col("_gap") + margin) * 100,
        }
    )
    return out.drop("_gap", "_pooled", "_error")


def finite_or_null(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
