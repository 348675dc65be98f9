"""Query registry, base tables and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themescope.functions.text import WHITESPACE
from themescope.functions.words import STOPWORDS
from themescope.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def meta(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a vector, a cluster (-1 where there is none) and a quality group."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"), "text", "lang", "source"
    )
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", "label")
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("row_id"), F.col("quality").cast("string").alias("quality")
    )
    return (
        docs.join(vectors, "row_id", "left")
        .join(labels, "row_id", "left")
        .withColumn("cluster", F.coalesce("label", F.lit(-1)))
        .drop("label")
    )


META = """meta AS (
  SELECT d.doc_id AS row_id, d.text, d.lang, d.source, CAST(l.quality AS VARCHAR) AS quality,
         e.embedding, COALESCE(e.label, -1) AS cluster
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
                   LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def conv(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns, clustered by the power of two their length reaches."""
    size = F.length("text")
    steps = sum((F.when(size >= 2**i, 1).otherwise(0) for i in range(1, 17)), F.lit(0))
    return (
        table(spark, folder, "conversations")
        .where(size > 0)
        .select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text", "role", steps.alias("cluster"))
    )


CONV = (
    "conv AS (SELECT conv_id * 1000 + turn AS row_id, text, role, "
    + " + ".join(f"(CASE WHEN length(text) >= {2**i} THEN 1 ELSE 0 END)" for i in range(1, 17))
    + " AS cluster FROM conversations WHERE length(text) > 0)"
)


def conv_clusters(rows: DataFrame) -> DataFrame:
    """``(cluster, label)`` of the clusters that occur, written once."""
    return cut_lineage(
        rows.where(F.col("cluster") >= 0)
        .select("cluster")
        .distinct()
        .select("cluster", F.concat(F.lit("Cluster "), (F.col("cluster") + 1).cast("string")).alias("label"))
    )


CLUSTERS = """clusters AS (
  SELECT DISTINCT cluster, 'Cluster ' || CAST(cluster + 1 AS VARCHAR) AS label
  FROM {rows} WHERE cluster >= 0)"""


def strip_sql(column: str) -> str:
    return f"trim({column}, '{WHITESPACE}')"


def words_sql(column: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+'), "
        "lambda w: regexp_full_match(w, '[a-z]{3,}'))"
    )


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def erf_sql(x: str) -> str:
    """Power series of the error function with factorials by lgamma."""
    return (
        f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 6 THEN 1.0 WHEN {x} <= 0 THEN 0.0 ELSE "
        f"1.1283791670955126 * exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 201), lambda n: "
        f"exp(2 * n * ln(2.0) + lgamma(n + 1.0) + (2 * n + 1) * ln({x}) - lgamma(2 * n + 2.0)))) END)"
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round the named columns; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) + F.lit(0.0) for c in columns})


def r6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"
