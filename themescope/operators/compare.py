"""Cluster by group comparison, computed from one small table of counts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themescope.functions.stats import chi_square_p, finite_or_null, with_two_proportion_test
from themescope.functions.text import strip
from themescope.operators.profile import keep_groups

TESTS = ("Z_Score", "P_Value", "CI_Lower", "CI_Upper")


def cells(rows: DataFrame, group_col: str, groups: list[str]) -> DataFrame:
    """``(cluster, grp, n)`` over rows of the chosen groups, noise included.

    The only pass over the rows; counts combine before the shuffle, so a group
    or cluster holding most rows costs nothing extra.
    """
    return (
        keep_groups(rows, group_col, groups)
        .groupBy(F.col("cluster"), strip(F.col(f"`{group_col}`").cast("string")).alias("grp"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def group_totals(counts: DataFrame) -> DataFrame:
    """Rows per group, noise included."""
    return counts.groupBy("grp").agg(F.sum("n").alias("n_group"))


def clustered_group_totals(counts: DataFrame) -> DataFrame:
    """Rows per group, noise left out."""
    return (
        counts.where(F.col("cluster") >= 0).groupBy("grp").agg(F.sum("n").alias("n_group_clustered"))
    )


def cluster_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cluster").agg(F.sum("n").alias("n_cluster"))


def totals_of(counts: DataFrame, groups: list[str]) -> dict[str, int]:
    """Group totals as a small dict; an error when no row is in any group."""
    found = {r["grp"]: int(r["n_group"]) for r in group_totals(counts).collect()}
    totals = {g: found.get(g, 0) for g in groups}
    if not sum(totals.values()):
        raise ValueError(f"no rows in any of the groups {groups}")
    return totals


def _counts_by_cluster(counts: DataFrame) -> DataFrame:
    """``(cluster, by_group map)``; a cluster has at most one entry per group."""
    return counts.groupBy("cluster").agg(
        F.map_from_entries(F.collect_list(F.struct("grp", "n"))).alias("_by_group")
    )


def _group_lines(lines: list[dict], schema: str) -> Column:
    """The groups as one array of structs: a single constant, however many groups there are."""
    return F.from_json(F.lit(json.dumps(lines)), f"array<struct<{schema}>>")


def shares(counts: DataFrame, clusters: DataFrame, totals: dict[str, int]) -> DataFrame:
    """``(cluster, label, grp, grp_ord, n, pct)`` for every listed cluster and group.

    Clusters without rows keep zero counts. Percent is of all rows of the
    group, noise included; 0 for an empty group.
    """
    groups = _group_lines(
        [{"grp": g, "grp_ord": i, "_total": n} for i, (g, n) in enumerate(totals.items())],
        "grp: string, grp_ord: int, _total: bigint",
    )
    pct = F.when(F.col("_total") > 0, F.col("n") / F.col("_total") * 100).otherwise(F.lit(0.0))
    return (
        clusters.select("cluster", "label", F.inline(groups))
        .join(counts.select("cluster", "grp", "n"), ["cluster", "grp"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
        .withColumn("pct", pct)
        .select("cluster", "label", "grp", "grp_ord", "n", "pct")
    )


def proportions(counts: DataFrame, clusters: DataFrame, totals: dict[str, int]) -> DataFrame:
    """Wide comparison: count and percent per group, difference when there are two.

    An empty cluster table gives an empty result with the same columns.
    """
    groups = list(totals)
    out = clusters.join(_counts_by_cluster(counts), "cluster", "left").select(
        F.col("label").alias("Cluster_Label"),
        F.col("cluster").alias("Cluster_ID"),
        *[
            F.coalesce(F.try_element_at("_by_group", F.lit(g)), F.lit(0)).cast("bigint").alias(f"{g}_Count")
            for g in groups
        ],
    )
    percents = {
        f"{g}_Percent": (
            F.col(f"`{g}_Count`") / F.lit(totals[g]) * 100 if totals[g] > 0 else F.lit(0.0)
        )
        for g in groups
    }
    out = out.withColumns(percents)
    if len(groups) == 2:
        a, b = groups
        out = out.withColumn("Difference", F.col(f"`{a}_Percent`") - F.col(f"`{b}_Percent`"))
    return out


def z_tests(wide: DataFrame, totals: dict[str, int]) -> DataFrame:
    """Add the two-proportion test per cluster; null columns unless two groups."""
    if len(totals) != 2:
        return wide.withColumns({name: F.lit(None).cast("double") for name in TESTS})
    (a, n_a), (b, n_b) = totals.items()
    return with_two_proportion_test(wide, n_a, F.col(f"`{a}_Count`"), n_b, F.col(f"`{b}_Count`"), TESTS)


def _grid(counts: DataFrame, lines: list[dict], schema: str) -> DataFrame:
    """Every cluster with every group, and the observed count or 0."""
    known = counts.where(F.col("cluster").isNotNull())
    return (
        known.groupBy("cluster")
        .agg(F.sum("n").alias("_n_cluster"))
        .select("cluster", "_n_cluster", F.inline(_group_lines(lines, schema)))
        .join(known.select("cluster", "grp", F.col("n").alias("observed")), ["cluster", "grp"], "left")
        .withColumn("observed", F.coalesce("observed", F.lit(0)).cast("bigint"))
    )


def crosstab(counts: DataFrame, groups: list[str]) -> DataFrame:
    """``(cluster, grp, observed)`` with zeros, noise row included, null cluster dropped."""
    grid = _grid(counts, [{"grp": g} for g in groups], "grp: string")
    return grid.select("cluster", "grp", "observed")


def expected(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Crosstab with expected counts and standardised residuals.

    Groups without a single row in any cluster are left out.
    """
    known = counts.where(F.col("cluster").isNotNull())
    found = {r["grp"]: int(r["n_group"]) for r in group_totals(known).collect()}
    present = {g: found[g] for g in groups if found.get(g)}
    total = sum(present.values())
    if not present:
        raise ValueError(f"no clustered rows in any of the groups {groups}")
    inside = known.where(F.col("grp").isin(list(present))) if len(found) > len(present) else known
    grid = _grid(inside, [{"grp": g, "_n": n} for g, n in present.items()], "grp: string, _n: bigint")
    grid = grid.select(
        "cluster", "grp", "observed", (F.col("_n_cluster") * (F.col("_n") / F.lit(total))).alias("expected")
    )
    gap = F.col("observed") - F.col("expected")
    return grid.withColumn("residual", finite_or_null(gap / F.sqrt("expected")))


def chi_square(grid: DataFrame) -> DataFrame:
    """One row ``(chi2, p_value, dof)`` from the output of ``expected``.

    With one degree of freedom each gap shrinks by up to one half (Yates).
    """
    gap = F.abs(F.col("observed") - F.col("expected"))
    yates = F.greatest(gap - F.least(F.lit(0.5), gap), F.lit(0.0))
    per_cluster = grid.groupBy("cluster").agg(
        F.sum(gap * gap / F.col("expected")).alias("plain"),
        F.sum(yates * yates / F.col("expected")).alias("corrected"),
        F.count(F.lit(1)).alias("n_groups"),
    )
    one = per_cluster.agg(
        F.sum("plain").alias("plain"),
        F.sum("corrected").alias("corrected"),
        ((F.count(F.lit(1)) - 1) * (F.max("n_groups") - 1)).alias("dof"),
    ).select(
        F.when(F.col("dof") == 0, 0.0)
        .when(F.col("dof") == 1, F.col("corrected"))
        .otherwise(F.col("plain"))
        .alias("chi2"),
        "dof",
    )
    return one.select("chi2", chi_square_p(F.col("chi2"), F.col("dof")).alias("p_value"), "dof")


def ordered(wide: DataFrame, groups: list[str]) -> DataFrame:
    """Largest absolute difference first, or the first group's percent."""
    if len(groups) == 2 and "Difference" in wide.columns:
        key = F.abs("Difference")
    else:
        key = F.col(f"`{groups[0]}_Percent`")
    return wide.orderBy(key.desc_nulls_last(), F.asc("Cluster_ID"))
