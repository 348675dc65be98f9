"""Clustering queries; results of iterative fits have no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from themescope.catalog.comparing import _with
from themescope.catalog.registry import meta, query, r6, rounded, table
from themescope.catalog.vectors import points
from themescope.functions.text import WHITESPACE
from themescope.operators import kmeans as km
from themescope.operators.density import density_cluster
from themescope.operators.linkage import agglomerative
from themescope.operators.reduce import pca_reduce, unit_length
from themescope.plans.steps import cluster_step
from themescope.session import cut_lineage

SCORES = """scores AS (SELECT label + 5 AS k,
  sum(sum(CAST(embedding[1] AS DOUBLE) ^ 2)) OVER (ORDER BY label DESC) AS inertia,
  avg(CAST(embedding[2] AS DOUBLE)) AS silhouette FROM embeddings GROUP BY label),
scaled AS (SELECT k, silhouette, (inertia - min(inertia) OVER ()) / nullif(max(inertia) OVER () - min(inertia) OVER (), 0) AS scaled FROM scores),
bends AS (SELECT *, lag(scaled) OVER (ORDER BY k) - 2 * scaled + lead(scaled) OVER (ORDER BY k) AS bend FROM scaled)"""


def _scores(spark, folder):
    """A falling curve and a score per k, both taken from the vectors."""
    rows = table(spark, folder, "embeddings")
    first, second = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    by_label = rows.groupBy("label").agg(F.sum(first * first).alias("s"), F.avg(second).alias("silhouette"))
    falling = W.orderBy(F.desc("label"))  # one line per label
    return by_label.select((F.col("label") + 5).alias("k"), F.sum("s").over(falling).alias("inertia"), "silhouette")


@query(
    "elbow_second_diff",
    _with(SCORES) + f"SELECT k, {r6('scaled')} AS scaled, {r6('bend')} AS bend FROM bends",
)
def elbow_second_diff(spark, folder):
    return rounded(km.second_differences(_scores(spark, folder)), "scaled", "bend")


@query(
    "choose_k",
    _with(
        SCORES,
        """picks AS (SELECT arg_max(k, (bend, -k)) FILTER (bend IS NOT NULL) AS elbow_k,
  arg_max(k, (silhouette, -k)) AS best_silhouette_k, max(silhouette) AS top FROM bends)""",
    )
    + """SELECT CASE WHEN top > 0.3 THEN best_silhouette_k ELSE elbow_k END AS optimal_k,
  CASE WHEN top > 0.3 THEN 'silhouette' ELSE 'elbow' END AS method, elbow_k, best_silhouette_k FROM picks""",
)
def choose_k(spark, folder):
    return km.choose_k(_scores(spark, folder))


@query("score_ks")
def score_ks(spark, folder):
    """The full search: 26 values of k, ten restarts each, on all rows."""
    return rounded(km.score_ks(points(spark, folder)), "inertia", "silhouette")


@query("pca_reduce")
def pca(spark, folder):
    """Lengths of the reduced vectors (signs of components are arbitrary)."""
    reduced, _ = pca_reduce(points(spark, folder), 16)
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    return rounded(reduced.select("row_id", F.size("vec").alias("width"), length.alias("length")), "length")


@query("kmeans_assign")
def kmeans_assign(spark, folder):
    return km.kmeans(unit_length(points(spark, folder)), 10)


@query("agglomerative")
def linkage(spark, folder):
    return agglomerative(unit_length(points(spark, folder)), 10)


@query("density_cluster")
def density(spark, folder):
    return density_cluster(unit_length(points(spark, folder)), 5)


@query("cluster_step")
def clustered(spark, folder):
    """Sentiment dimension, PCA, unit length, k-means and the cluster summary."""
    rows = meta(spark, folder).where(F.col("embedding").isNotNull()).drop("cluster")
    return cluster_step(rows, "kmeans", k=8, components=16).summary


def _separated(spark, folder):
    """Vectors pulled far apart by label, so that every sound method finds the labels."""
    far = F.transform("vec", lambda x, i: x + F.when(i == F.col("label"), 100.0).otherwise(0.0))
    return unit_length(points(spark, folder).select("row_id", far.alias("vec")))


def _named_by_first(found):
    """Clusters named by their least row."""
    return found.select("row_id", F.min("row_id").over(W.partitionBy("cluster")).alias("first_row"))


_LABELS = "SELECT vec_id AS row_id, min(vec_id) OVER (PARTITION BY label) AS first_row FROM embeddings"


@query("kmeans_separated", _LABELS)
def kmeans_separated(spark, folder):
    rows = _separated(spark, folder)
    k = table(spark, folder, "embeddings").select("label").distinct().count()
    return _named_by_first(km.kmeans(rows, k))


@query("agglomerative_separated", _LABELS)
def agglomerative_separated(spark, folder):
    k = table(spark, folder, "embeddings").select("label").distinct().count()
    return _named_by_first(agglomerative(_separated(spark, folder), k, group_rows=100))  # several groups


@query("density_separated", _LABELS)
def density_separated(spark, folder):
    split = {"block_rows": 200, "pack_edges": 300}  # several blocks and parts
    return _named_by_first(density_cluster(_separated(spark, folder), 15, **split))


@query(
    "pca_two_dims",
    f"""WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
c AS (SELECT vec_id, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM v),
m AS (SELECT avg(x * x) AS a, avg(x * y) AS b, avg(y * y) AS d FROM c),
e AS (SELECT a, b, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS top FROM m)
SELECT vec_id AS row_id, {r6('abs(x * b + y * (top - a)) / sqrt(b * b + (top - a) * (top - a))')} AS length
FROM c CROSS JOIN e""",
)
def pca_two_dims(spark, folder):
    """One component of two dimensions, where the eigenvector has a closed form."""
    flat = points(spark, folder).select("row_id", F.slice("vec", 1, 2).alias("vec"))
    reduced, _ = pca_reduce(flat, 1)
    return rounded(reduced.select("row_id", F.abs(F.col("vec")[0]).alias("length")), "length")


_FAR = """far AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]),
    lambda x, i: x + CASE WHEN i - 1 = label THEN 100.0 ELSE 0.0 END) AS vec FROM embeddings),
unit AS (SELECT vec_id, label, unnest(vec) / sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS x,
    unnest(range(len(vec))) AS dim FROM far)"""


@query(
    "score_ks_separated",
    f"""WITH {_FAR},
spread AS (SELECT label, dim, sum(x * x) - sum(x) * sum(x) / count(*) AS s FROM unit GROUP BY ALL)
SELECT CAST(count(DISTINCT label) AS INTEGER) AS optimal_k, 'silhouette' AS method, {r6('sum(s)')} AS inertia FROM spread""",
)
def score_ks_separated(spark, folder):
    """The search on vectors that are far apart by label: it finds their number, and the inertia of the labels."""
    k = table(spark, folder, "embeddings").select("label").distinct().count()
    scores = cut_lineage(km.score_ks(_separated(spark, folder), max(2, k - 2), k + 2))
    best = km.choose_k(scores).select("optimal_k", "method")
    found = best.join(scores.select(F.col("k").alias("optimal_k"), "inertia"), "optimal_k")
    return rounded(found, "inertia")


@query(
    "cluster_step_separated",
    """WITH kept AS (SELECT d.doc_id, e.label, d.text FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id),
sizes AS (SELECT label, min(doc_id) AS first_row, count(*) AS n_rows,
  count(*) FILTER (length(trim(text, '"""
    + WHITESPACE
    + """')) > 0) AS message_count FROM kept GROUP BY label)
SELECT first_row, n_rows, message_count FROM sizes""",
)
def cluster_step_separated(spark, folder):
    """The whole step on separated vectors: rows of each cluster and the size its summary reports."""
    far = F.transform(
        F.col("embedding").cast("array<double>"), lambda x, i: x + F.when(i == F.col("cluster"), 100.0).otherwise(0.0)
    )
    rows = meta(spark, folder).where(F.col("embedding").isNotNull()).withColumn("embedding", far)
    k = rows.select("cluster").distinct().count()
    done = cluster_step(rows.drop("cluster"), "kmeans", k=k, components=None, sentiment=False, category_columns=None)
    sizes = done.rows.groupBy("cluster").agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n_rows"))
    reported = done.summary.select(F.col("Cluster_ID").alias("cluster"), F.col("Message_Count").alias("message_count"))
    return sizes.join(reported, "cluster", "left").select(
        "first_row", "n_rows", F.coalesce("message_count", F.lit(0)).alias("message_count")
    )
