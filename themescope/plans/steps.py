"""The three steps end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.functions.text import is_blank, strip
from themescope.operators import compare
from themescope.operators.density import density_cluster
from themescope.operators.embed import Embedder, embed_text
from themescope.operators.kmeans import choose_k, kmeans, score_ks
from themescope.operators.linkage import agglomerative
from themescope.operators.neighbors import nearest_label
from themescope.operators.profile import (
    choose_group_column,
    keep_groups,
    select_groups,
    text_column_name,
)
from themescope.operators.reduce import COMPONENTS, augment, pca_reduce, unit_length
from themescope.operators.rows import slice_rows
from themescope.operators.summary import Labeller, cluster_summary
from themescope.session import cut_lineage
from themescope.sources.lexicon import Lexicon
from themescope.sources.tables import load_chosen_k, save_chosen_k


def clean_rows(rows: DataFrame, text_column: str) -> DataFrame:
    """Non-blank rows with the trimmed text as ``text``, replacing any such column."""
    return rows.withColumn("text", strip(F.col(f"`{text_column}`"))).where(~is_blank(F.col("text")))


def embed_step(
    rows: DataFrame,
    text_column: str,
    skip: int = 0,
    limit: int | None = None,
    embedder: Embedder | None = None,
    second: Embedder | None = None,
    calls: int | None = None,
    width: int | None = None,
) -> DataFrame:
    """Input rows with ``row_id`` to metadata plus ``text``, ``embedding``, ``failed``."""
    kept = slice_rows(clean_rows(rows, text_column), "row_id", skip, limit)
    return embed_text(kept, embedder, second, calls, width)


@dataclass
class Clustering:
    rows: DataFrame  # metadata with cluster
    summary: DataFrame
    k: int | None
    explained: float | None


def resolve_k(rows: DataFrame, k: int | None, stored_at: str | None, **search) -> int:
    """A given k, else a stored one, else the search on raw vectors, which is stored."""
    spark = rows.sparkSession
    if k is not None:
        return k
    if stored_at:
        found = load_chosen_k(spark, stored_at)
        if found is not None:
            return found
    chosen = choose_k(score_ks(rows.select("row_id", F.col("embedding").alias("vec")), **search)).first()
    if stored_at:
        save_chosen_k(spark, chosen["optimal_k"], stored_at)
    return int(chosen["optimal_k"])


def cluster_step(
    rows: DataFrame,
    algorithm: str = "hdbscan",
    k: int | None = None,
    min_cluster_size: int | None = None,
    assign_noise: bool = False,
    components: int | None = COMPONENTS,
    sentiment: bool = True,
    lexicon: Lexicon | None = None,
    labeller: Labeller | None = None,
    category_columns: list[str] | str | None = "auto",
    stored_k: str | None = None,
    **options,
) -> Clustering:
    """Vectors with metadata to rows with ``cluster`` and one summary row per cluster."""
    if algorithm not in ("hdbscan", "kmeans", "agglomerative"):
        raise ValueError(f"unknown algorithm {algorithm!r}: use hdbscan, kmeans or agglomerative")
    if "text" not in rows.columns and text_column_name(rows):
        rows = rows.withColumnRenamed(text_column_name(rows), "text")
    rows = cut_lineage(rows)  # texts are read for their vectors and again for the summary, and may come from joins
    if algorithm != "hdbscan":
        k = resolve_k(rows, k, stored_k)
    prepared = augment(rows, lexicon) if sentiment and "text" in rows.columns else rows
    vectors = prepared.select("row_id", F.col("embedding").cast("array<double>").alias("vec"))
    explained = None
    if components:
        vectors, explained = pca_reduce(vectors, components)
    vectors = cut_lineage(unit_length(vectors))
    if algorithm == "hdbscan":
        labels = cut_lineage(density_cluster(vectors, min_cluster_size, **options))
        if assign_noise:
            labels = nearest_label(vectors.join(labels, "row_id"))
    elif algorithm == "kmeans":
        labels = kmeans(vectors, k, **options)
    else:
        labels = agglomerative(vectors, k, **options)
    named = rows.drop("embedding", "cluster").join(labels, "row_id")
    # One line per cluster; every report and chart reads it again.
    summary = cut_lineage(cluster_summary(named, labeller, category_columns))
    return Clustering(named, summary, k, explained)


@dataclass
class Comparison:
    group_col: str
    groups: list[str]
    totals: dict[str, int]
    counts: DataFrame  # (cluster, grp, n), cached
    clusters: DataFrame  # (cluster, label)
    table: DataFrame  # wide, tested and ordered
    shares: DataFrame  # long
    grid: DataFrame  # observed, expected, residual
    chi_square: DataFrame  # one row


def compare_step(
    rows: DataFrame,
    clusters: DataFrame,
    group_col: str | None = None,
    groups: list[str] | None = None,
) -> Comparison:
    """Rows with ``cluster`` and a ``(cluster, label)`` table to all comparison tables.

    The rows are read once, into counts per cluster and group; every other table
    comes from those.
    """
    column = choose_group_column(rows, group_col)
    names = select_groups(rows, column, groups)
    counts = cut_lineage(compare.cells(keep_groups(rows, column, names), column, names))
    totals = compare.totals_of(counts, names)
    clusters = cut_lineage(clusters.select("cluster", "label"))  # one line each, used by every table
    wide = compare.z_tests(compare.proportions(counts, clusters, totals), totals)
    grid = compare.expected(counts, names)
    return Comparison(
        column,
        names,
        totals,
        counts,
        clusters,
        compare.ordered(wide, names),
        compare.shares(counts, clusters, totals),
        grid,
        compare.chi_square(grid),
    )
