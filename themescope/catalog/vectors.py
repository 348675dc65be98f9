"""Embedding, vector preparation and neighbour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from themescope.catalog.comparing import _with
from themescope.catalog.registry import CONV, META, conv, meta, query, r6, rounded, strip_sql, table, words_sql
from themescope.catalog.texts import SENTIMENT
from themescope.operators.density import core_distances, distinct_points, reach_edges
from themescope.operators.embed import distinct_texts, embed_text, hashed_vectors
from themescope.operators.kmeans import nearest_centroid, silhouette
from themescope.operators.neighbors import build_index, knn, nearest_label
from themescope.operators.reduce import augment, unit_length
from themescope.operators.rows import join_repeated
from themescope.plans.steps import embed_step
from themescope.session import cut_lineage

WIDTH = 64
# Rows a block in the neighbour queries: small, so that several blocks are searched.
BLOCK = 150


def _slots(rows, key):
    return f"""slots AS (SELECT {key}, slot, CAST(count(*) AS DOUBLE) AS value FROM (
  SELECT {key}, ('0x' || substr(md5(unnest({words_sql('text')})), 1, 8))::BIGINT % {WIDTH} AS slot FROM {rows}) GROUP BY ALL)"""


def _exploded(df, key):
    """One line per non-zero dimension (the outer form infers no filter that repeats the vector)."""
    return (
        df.select(key, F.posexplode_outer("embedding").alias("slot", "value"))
        .where(F.col("value") != 0)
        .select(key, F.col("slot").cast("bigint").alias("slot"), F.col("value").cast("double").alias("value"))
    )


@query(
    "embed_dedup_join",
    _with(CONV) + "SELECT row_id, min(row_id) OVER (PARTITION BY text) AS rep_id FROM conv",
)
def embed_dedup_join(spark, folder):
    rows = conv(spark, folder).select("row_id", "text")
    return join_repeated(rows, distinct_texts(rows), "text").select("row_id", "rep_id")


@query(
    "embed_hashing",
    _with(
        "texts AS (SELECT min(doc_id) AS rep_id, text FROM documents GROUP BY text)", _slots("texts", "rep_id")
    )
    + "SELECT rep_id, slot, value FROM slots",
)
def embed_hashing(spark, folder):
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return _exploded(hashed_vectors(distinct_texts(rows)), "rep_id")


@query(
    "embed_step",
    _with(
        CONV,
        f"""kept AS (SELECT row_id, {strip_sql('text')} AS text FROM (
  SELECT *, row_number() OVER (ORDER BY row_id) AS place FROM conv WHERE length({strip_sql('text')}) > 0) WHERE place > 10)""",
        _slots("kept", "row_id"),
    )
    + "SELECT row_id, slot, value FROM slots",
)
def embedded(spark, folder):
    return _exploded(embed_step(conv(spark, folder), "text", skip=10), "row_id")


NUMBERS = """mixed AS (SELECT doc_id AS row_id, CASE WHEN lang = 'fr' THEN CAST(n_chars AS VARCHAR) ELSE text END AS text
  FROM documents)"""


@query(
    "zero_fill",
    _with(NUMBERS)
    + f"""SELECT row_id, {WIDTH} AS width, 0.0::DOUBLE AS total FROM mixed WHERE len({words_sql('text')}) = 0""",
)
def zero_fill(spark, folder):
    """Texts without a single word get a zero vector of full width."""
    docs = table(spark, folder, "documents")
    text = F.when(F.col("lang") == "fr", F.col("n_chars").cast("string")).otherwise(F.col("text"))
    vectors = embed_text(docs.select(F.col("doc_id").alias("row_id"), text.alias("text")))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return vectors.select("row_id", F.size("embedding").alias("width"), total.alias("total")).where(F.col("total") == 0)


@query(
    "vectors_join_meta",
    """SELECT d.doc_id AS row_id, d.lang, len(e.embedding) AS width, round(CAST(e.embedding[1] AS DOUBLE), 6) + 0.0 AS first_value
FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id""",
)
def vectors_join_meta(spark, folder):
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    joined = docs.join(vectors, "row_id").select(
        "row_id", "lang", F.size("embedding").cast("bigint").alias("width"),
        F.col("embedding")[0].cast("double").alias("first_value"),
    )
    return rounded(joined, "first_value")


def points(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


POINTS = "pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
DIST = "sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


@query(
    "l2_normalize",
    _with(
        POINTS,
        "lens AS (SELECT id, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS n FROM pts)",
    )
    + """SELECT row_id, dim, round(value, 6) + 0.0 AS value FROM (SELECT id AS row_id, CAST(unnest(range(len(vec))) AS BIGINT) AS dim,
  unnest(list_transform(vec, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END)) AS value FROM lens)""",
)
def l2_normalize(spark, folder):
    out = unit_length(points(spark, folder)).select("row_id", F.posexplode("vec").alias("dim", "value"))
    return rounded(out.withColumn("dim", F.col("dim").cast("bigint")), "value")


@query(
    "augment_vector",
    _with(META)
    + f"""SELECT row_id, dim, round(value, 6) + 0.0 AS value FROM (
  SELECT row_id, CAST(unnest(range(len(embedding) + 1)) AS BIGINT) AS dim,
    unnest(list_append(CAST(embedding AS DOUBLE[]), 0.5 * ({SENTIMENT}))) AS value
  FROM meta WHERE embedding IS NOT NULL)""",
)
def augment_vector(spark, folder):
    rows = meta(spark, folder).where(F.col("embedding").isNotNull())
    out = augment(rows).select("row_id", F.posexplode_outer("embedding").alias("dim", "value"))
    return rounded(out.withColumn("dim", F.col("dim").cast("bigint")), "value")


@query(
    "nearest_centroid",
    _with(
        POINTS,
        """flat AS (SELECT label, unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM pts),
means AS (SELECT label, dim, avg(x) AS m FROM flat GROUP BY ALL),
mids AS (SELECT label, list(m ORDER BY dim) AS vec FROM means GROUP BY label)""",
        f"pairs AS (SELECT a.id, b.label, {DIST} AS d FROM pts a CROSS JOIN mids b)",
    )
    + "SELECT id AS row_id, arg_min(label, (d, label)) AS cluster, round(min(d), 6) AS dist FROM pairs GROUP BY id",
)
def nearest(spark, folder):
    rows = points(spark, folder)
    means = (
        rows.select("label", F.posexplode("vec").alias("dim", "x"))
        .groupBy("label", "dim")
        .agg(F.avg("x").alias("m"))
        .groupBy(F.col("label").alias("cluster"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("vec"))
    )
    return rounded(nearest_centroid(rows, means), "dist")


@query(
    "noise_nearest",
    _with(
        POINTS,
        "a AS (SELECT id, vec, CASE WHEN label >= 5 THEN -1 ELSE label END AS cluster FROM pts)",
        f"""found AS (SELECT a.id, arg_min(b.cluster, ({DIST}, b.id)) AS cluster
  FROM a CROSS JOIN a b WHERE a.cluster = -1 AND b.cluster <> -1 GROUP BY a.id)""",
    )
    + """SELECT a.id AS row_id, CASE WHEN (SELECT count(*) FROM a WHERE cluster <> -1) = 0 THEN a.cluster
  ELSE COALESCE(found.cluster, a.cluster) END AS cluster FROM a LEFT JOIN found ON found.id = a.id""",
)
def noise_nearest(spark, folder):
    rows = points(spark, folder)
    noisy = rows.select(
        "row_id", "vec", F.when(F.col("label") >= 5, -1).otherwise(F.col("label")).alias("cluster")
    )
    return nearest_label(noisy, block_rows=BLOCK)


NEAR = f"""near AS MATERIALIZED (SELECT qid, id, w, row_number() OVER (PARTITION BY qid ORDER BY w, id) AS place
  FROM (SELECT a.id AS qid, b.id, {DIST} AS w FROM pts a CROSS JOIN pts b WHERE a.id <> b.id) QUALIFY place <= 10)"""


def _near(spark, folder, k):
    rows = points(spark, folder).select(F.col("row_id").alias("id"), "vec")
    return knn(rows, k, build_index(rows, block_rows=BLOCK))


@query("knn_topk", _with(POINTS, NEAR) + f"SELECT qid, id, {r6('w')} AS w FROM near WHERE place <= 5")
def knn_topk(spark, folder):
    return rounded(_near(spark, folder, 5), "w")


@query(
    "core_distance", _with(POINTS, NEAR) + f"SELECT qid AS id, {r6('w')} AS core FROM near WHERE place = 5"
)
def core_distance(spark, folder):
    known = distinct_points(points(spark, folder))
    return rounded(core_distances(_near(spark, folder, 10), known, 5), "core")


@query(
    "mutual_reach",
    _with(POINTS, NEAR, "cores AS (SELECT qid AS id, w AS core FROM near WHERE place = 5)")
    + f"""SELECT n.qid AS src, n.id AS dst, {r6('greatest(n.w, a.core, b.core)')} AS w
FROM near n JOIN cores a ON a.id = n.qid JOIN cores b ON b.id = n.id""",
)
def mutual_reach(spark, folder):
    near = cut_lineage(_near(spark, folder, 10))
    known = distinct_points(points(spark, folder))
    return rounded(reach_edges(near, core_distances(near, known, 5)), "w")


@query(
    "silhouette",
    _with(
        POINTS,
        f"""sums AS (SELECT a.id, a.label, b.label AS other, sum({DIST}) AS s, count(*) AS n
  FROM pts a CROSS JOIN pts b GROUP BY ALL)""",
        """sides AS (SELECT id, max(CASE WHEN other = label THEN s / nullif(n - 1, 0) END) AS a,
  min(CASE WHEN other <> label THEN s / n END) AS b FROM sums GROUP BY id)""",
    )
    + f"""SELECT count(*) AS n, {r6("avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END)")} AS silhouette FROM sides""",
)
def silhouettes(spark, folder):
    rows = points(spark, folder).withColumnRenamed("label", "cluster")
    return rounded(silhouette(rows), "silhouette")
