"""The ranked tables that reports and charts are drawn from.

``share`` below is the long table ``(cluster, label, grp, grp_ord, n, pct)`` of
``compare.shares``; ``wide`` is the comparison of ``compare.proportions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from themescope.operators.rows import first_in_group

ALPHA = 0.05


def largest_clusters(share: DataFrame, n: int) -> DataFrame:
    """``(cluster, label, n_cluster)`` for the n largest by summed counts."""
    return (
        share.groupBy("cluster", "label")
        .agg(F.sum("n").alias("n_cluster"))
        .orderBy(F.desc("n_cluster"), F.asc("cluster"))
        .limit(n)
    )


def sizes(summary: DataFrame, n: int = 25) -> DataFrame:
    return (
        summary.select("Cluster_ID", "Cluster_Label", "Message_Count")
        .orderBy(F.desc("Message_Count"), F.asc("Cluster_ID"))
        .limit(n)
    )


def pie(summary: DataFrame, total_rows: int, n: int = 10) -> DataFrame:
    """``(place, label, n)``: largest clusters and what is left of all clustered rows."""
    ranked = W.orderBy(F.desc("n"), F.asc("cluster"))
    top = (
        summary.select(
            F.col("Cluster_ID").alias("cluster"),
            F.col("Cluster_Label").alias("label"),
            F.col("Message_Count").alias("n"),
        )
        .orderBy(F.desc("n"), F.asc("cluster"))
        .limit(n)
        .withColumn("place", F.row_number().over(ranked))
        .select("place", "label", "n")
    )
    more = summary.select("Cluster_ID").limit(n + 1).agg(F.count(F.lit(1)).alias("seen"))
    rest = (
        top.agg(F.sum("n").alias("shown"))
        .select(
            F.lit(n + 1).alias("place"),
            F.lit("Other").alias("label"),
            (F.lit(total_rows) - F.col("shown")).cast("bigint").alias("n"),
        )
        .where((F.col("n") > 0) & (more.select("seen").scalar() > n))
    )
    return top.unionByName(rest)


def mix(share: DataFrame, n: int = 10) -> DataFrame:
    """``(grp, label, pct)``: each group's percent in the largest clusters, rest as Other."""
    top = largest_clusters(share, n).select("cluster")
    kept = share.join(top, "cluster", "left_semi").select("grp", "label", "pct")
    more = share.select("cluster").distinct().limit(n + 1).agg(F.count(F.lit(1)).alias("seen"))
    rest = (
        kept.groupBy("grp")
        .agg(F.greatest(F.lit(0.0), 100.0 - F.sum("pct")).alias("pct"))
        .where(more.select("seen").scalar() > n)
        .select("grp", F.lit("Other").alias("label"), "pct")
    )
    return kept.unionByName(rest)


def heatmap(wide: DataFrame, groups: list[str], n: int = 20) -> DataFrame:
    """Percent per group for the largest clusters; n = 15 for the bar form."""
    total = sum((F.coalesce(F.col(f"`{g}_Count`"), F.lit(0)) for g in groups), F.lit(0))
    return (
        wide.withColumn("Total_Count", total.cast("bigint"))
        .orderBy(F.desc("Total_Count"), F.asc("Cluster_ID"))
        .limit(n)
        .select(
            "Cluster_ID", "Cluster_Label", "Total_Count", *[F.col(f"`{g}_Percent`") for g in groups]
        )
    )


def bars(wide: DataFrame, groups: list[str], n: int = 15) -> DataFrame | None:
    """The heatmap table for two or three groups; nothing for other numbers."""
    return heatmap(wide, groups, n) if len(groups) in (2, 3) else None


def facets(share: DataFrame, max_groups: int = 5, n: int = 12) -> DataFrame:
    """``(grp, place, cluster, label, pct)``: top clusters of the largest groups."""
    top_groups = (
        share.groupBy("grp", "grp_ord")
        .agg(F.sum("n").alias("n_group"))
        .orderBy(F.desc("n_group"), F.asc("grp_ord"))
        .limit(max_groups)
        .select("grp")
    )
    chosen = share.join(top_groups, "grp", "left_semi")
    return first_in_group(chosen, ["grp"], [F.desc("pct"), F.asc("cluster")], n, "place").select(
        "grp", "place", "cluster", "label", "pct"
    )


def dominant(share: DataFrame) -> DataFrame:
    """Per cluster: total, the group with the highest percent, and that percent."""
    best = F.max(F.struct(F.col("pct"), (-F.col("grp_ord")).alias("o"), F.col("grp")))
    return (
        share.groupBy("cluster", "label")
        .agg(F.sum("n").alias("n_cluster"), best.alias("best"))
        .select(
            "cluster",
            "label",
            "n_cluster",
            F.col("best.grp").alias("dominant_group"),
            F.col("best.pct").alias("dominant_share"),
        )
    )


def edges(share: DataFrame, n: int = 20) -> DataFrame:
    """``(source, target, value)`` cluster-to-group edges over numbered nodes."""
    ranked = W.orderBy(F.desc("n_cluster"), F.asc("cluster"))
    nodes = largest_clusters(share, n).select(
        "cluster", (F.row_number().over(ranked) - 1).alias("source")
    )
    shown = nodes.agg(F.count(F.lit(1)).alias("n_nodes")).select("n_nodes")
    return (
        share.where(F.col("n") > 0)
        .join(nodes, "cluster")
        .select(
            F.col("source").cast("bigint").alias("source"),
            (F.col("grp_ord") + shown.scalar()).cast("bigint").alias("target"),
            F.col("n").alias("value"),
        )
    )


def top_per_group(share: DataFrame, tests: DataFrame | None = None, n: int = 5) -> DataFrame:
    """``(grp, grp_ord, place, label, pct, p_value)``: highest shares of each group."""
    top = first_in_group(share, ["grp"], [F.desc("pct"), F.asc("cluster")], n, "place")
    if tests is None:
        joined = top.withColumn("p_value", F.lit(None).cast("double"))
    else:
        p = tests.select(F.col("Cluster_ID").alias("cluster"), F.col("P_Value").alias("p_value"))
        joined = top.join(p, "cluster", "left")
    return joined.select("grp", "grp_ord", "place", "cluster", "label", "pct", "p_value")


def significant(tested: DataFrame, groups: list[str], n: int = 10) -> DataFrame:
    """Largest significant differences and the group they point to."""
    a, b = groups
    return (
        tested.where(F.col("P_Value") < ALPHA)
        .orderBy(F.abs("Difference").desc(), F.asc("Cluster_ID"))
        .limit(n)
        .select(
            "Cluster_ID",
            "Cluster_Label",
            "Difference",
            F.when(F.col("Difference") > 0, f"more in {a}").otherwise(f"more in {b}").alias("direction"),
            "P_Value",
            "CI_Lower",
            "CI_Upper",
        )
    )


def largest_residuals(grid: DataFrame, clusters: DataFrame, n: int = 10) -> DataFrame:
    """Cells furthest from expectation, with label and direction."""
    top = (
        grid.where(F.col("residual").isNotNull())
        .orderBy(F.abs("residual").desc(), F.asc("cluster"), F.asc("grp"))
        .limit(n)
    )
    return with_labels(top, clusters).select(
        "cluster",
        "label",
        "grp",
        "residual",
        F.when(F.col("residual") > 0, "over").otherwise("under").alias("direction"),
    )


def with_labels(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """Add ``label``; clusters not listed (noise, say) get a name from their id."""
    named = clusters.select("cluster", "label")
    unknown = F.concat(F.lit("Cluster_ID "), F.col("cluster").cast("string"))
    return df.join(named, "cluster", "left").withColumn("label", F.coalesce("label", unknown))


def overview_shares(summary: DataFrame, total_rows: int) -> DataFrame:
    pct = F.lit(100.0) * F.col("Message_Count") / F.lit(total_rows) if total_rows else F.lit(0.0)
    return summary.select("Cluster_ID", "Cluster_Label", "Message_Count", pct.alias("pct"))
