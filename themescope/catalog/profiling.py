"""Scans, row selection and column profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from themescope.catalog.comparing import THREE_LONG, _three, _with
from themescope.catalog.registry import CONV, META, conv, meta, query, strip_sql, table
from themescope.functions.text import distinct_names
from themescope.operators import compare, profile
from themescope.operators.rows import hash_sample, slice_rows
from themescope.plans.steps import clean_rows
from themescope.sources.lexicon import split_words
from themescope.sources.tables import coerce_comparison, stack
from themescope.sources.text_csv import with_row_id

_BREAKS = "[,\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


@query(
    "scan_meta",
    _with(META) + "SELECT row_id, lang, source, quality, cluster, length(text) AS n_chars FROM meta",
)
def scan_meta(spark, folder):
    return meta(spark, folder).select(
        "row_id", "lang", "source", "quality", "cluster", F.length("text").cast("bigint").alias("n_chars")
    )


@query(
    "scan_vectors",
    "SELECT vec_id, CAST(unnest(range(len(embedding))) AS BIGINT) AS dim, "
    "round(CAST(unnest(embedding) AS DOUBLE), 6) + 0.0 AS value FROM embeddings",
)
def scan_vectors(spark, folder):
    return (
        table(spark, folder, "embeddings")
        .select("vec_id", F.posexplode("embedding").alias("dim", "value"))
        .select(
            "vec_id", F.col("dim").cast("bigint").alias("dim"),
            (F.round(F.col("value").cast("double"), 6) + F.lit(0.0)).alias("value"),
        )
    )


@query(
    "append_union",
    "SELECT doc_id, lang, source FROM documents UNION ALL BY NAME SELECT doc_id, lang, n_chars FROM documents",
)
def append_union(spark, folder):
    docs = table(spark, folder, "documents")
    return stack(docs.select("doc_id", "lang", "source"), docs.select("doc_id", "lang", "n_chars"))


@query(
    "word_list_parse",
    f"""SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_parts, md5(array_to_string(parts, '|')) AS digest FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '{_BREAKS}'),
    lambda w: {strip_sql('w')}), lambda w: length(w) > 0) AS parts FROM documents)""",
)
def word_list_parse(spark, folder):
    parts = table(spark, folder, "documents").select("doc_id", split_words(F.col("text")).alias("parts"))
    return parts.select(
        "doc_id", F.size("parts").cast("bigint").alias("n_parts"), F.md5(F.array_join("parts", "|")).alias("digest")
    )


@query(
    "nonblank_text",
    f"""SELECT conv_id, turn, md5({strip_sql('text')}) AS digest FROM conversations
WHERE length({strip_sql('text')}) > 0""",
)
def nonblank_text(spark, folder):
    kept = clean_rows(table(spark, folder, "conversations"), "text")
    return kept.select("conv_id", "turn", F.md5("text").alias("digest"))


@query(
    "skip_limit",
    _with(
        CONV,
        f"""numbered AS (SELECT row_id, role, row_number() OVER (ORDER BY row_id) AS place FROM conv
  WHERE length({strip_sql('text')}) > 0)""",
    )
    + "SELECT row_id, role FROM numbered WHERE place BETWEEN 21 AND 70",
)
def skip_limit(spark, folder):
    rows = clean_rows(conv(spark, folder), "text")
    return slice_rows(rows, "row_id", skip=20, limit=50).select("row_id", "role")


@query(
    "project_text",
    f"""SELECT doc_id, lang, source, n_chars, md5({strip_sql('text')}) AS text FROM documents
WHERE length({strip_sql('text')}) > 0""",
)
def project_text(spark, folder):
    rows = clean_rows(table(spark, folder, "documents"), "text")
    return rows.withColumn("text", F.md5("text"))


def _is_text_sql(name, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COALESCE(bool_or(length({strip_sql(f'CAST({c} AS VARCHAR)')}) > 0
  AND try_cast({strip_sql(f'CAST({c} AS VARCHAR)')} AS DOUBLE) IS NULL), false) AS is_text FROM {name}"""
        for c in columns
    )


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("col_is_string", _is_text_sql("customer", _CUSTOMER))
def col_is_string(spark, folder):
    return profile.is_text_column(table(spark, folder, "customer"), _CUSTOMER)


_DOCUMENT = ["text", "lang", "source", "n_chars"]


@query(
    "col_majority_text",
    "WITH long AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM documents WHERE {c} IS NOT NULL"
        for c in _DOCUMENT
    )
    + f"""), head AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY doc_id) AS place FROM long)
SELECT "column", count(*) AS n_sampled,
  count(*) FILTER (NOT regexp_full_match({strip_sql("replace(replace(value, '.', ''), '-', '')")}, '\\p{{Nd}}+')) AS n_text,
  count(*) FILTER (NOT regexp_full_match({strip_sql("replace(replace(value, '.', ''), '-', '')")}, '\\p{{Nd}}+')) * 2 > count(*) AS is_text
FROM head WHERE place <= 500 GROUP BY "column" """,
)
def col_majority_text(spark, folder):
    return profile.mostly_text_columns(table(spark, folder, "documents"), "doc_id", _DOCUMENT)


_PROFILED = ["row_id", "lang", "source", "quality"]
_DISTINCT = "vals AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS \"column\", {strip_sql(f'CAST({c} AS VARCHAR)')} AS value FROM meta "
    f"WHERE length({strip_sql(f'CAST({c} AS VARCHAR)')}) > 0"
    for c in _PROFILED
) + ")"


@query(
    "category_columns",
    _with(META, _DISTINCT)
    + 'SELECT "column", count(*) AS n_values FROM vals GROUP BY "column" HAVING count(*) BETWEEN 2 AND 50',
)
def category_columns(spark, folder):
    return profile.compare_columns(meta(spark, folder).drop("embedding"))


@query(
    "summary_category_values",
    _with(META, _DISTINCT)
    + """SELECT "column", value FROM vals WHERE "column" IN
(SELECT "column" FROM vals GROUP BY "column" HAVING count(*) BETWEEN 2 AND 200)""",
)
def summary_category_values(spark, folder):
    found = profile.summary_columns(meta(spark, folder).drop("embedding"))
    return found.select("column", F.explode("values").alias("value"))


@query("group_values", _with(META) + f"SELECT DISTINCT {strip_sql('source')} AS grp FROM meta ORDER BY grp")
def group_values(spark, folder):
    return profile.group_values(meta(spark, folder), "source")


@query("group_filter", _with(META) + "SELECT row_id, lang FROM meta WHERE lang IN ('en', 'fr')")
def group_filter(spark, folder):
    return profile.keep_groups(meta(spark, folder), "lang", ["en", "fr"]).select("row_id", "lang")


@query(
    "group_semi",
    """SELECT doc_id, source FROM documents WHERE source IN
(SELECT d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)""",
)
def group_semi(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    toxic = table(spark, folder, "labels").where(F.col("toxic") == 1).select("doc_id")
    chosen = docs.join(toxic, "doc_id", "left_semi").select("source").distinct()
    return docs.join(chosen, "source", "left_semi").select("doc_id", "source")


@query(
    "group_anti",
    """SELECT DISTINCT o_orderpriority AS grp FROM orders
WHERE o_orderpriority NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)""",
)
def group_anti(spark, folder):
    """Asked-for names that do not occur in the group column."""
    asked = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("grp")).distinct()
    asked = asked.union(table(spark, folder, "documents").select("lang").distinct())
    present = profile.group_values(table(spark, folder, "documents"), "lang")
    return asked.join(present, "grp", "left_anti")


@query(
    "group_distinct",
    f"""SELECT doc_id, CAST(len(list_distinct(list_filter(list_transform(string_split(text, ','),
  lambda w: {strip_sql('w')}), lambda w: length(w) > 0))) AS BIGINT) AS n_names FROM documents""",
)
def group_distinct(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.size(distinct_names(F.col("text"))).cast("bigint").alias("n_names"))


_MIXED = "CASE WHEN lang = 'fr' THEN 'x' || CAST(cluster AS VARCHAR) ELSE CAST(cluster AS VARCHAR) END"


@query(
    "clustered_rows",
    _with(META) + f"SELECT row_id, lang FROM meta WHERE COALESCE(try_cast({_MIXED} AS DOUBLE), -1) >= 0",
)
def clustered_rows(spark, folder):
    """Cluster ids as text, some of them unreadable."""
    number = F.col("cluster").cast("string")
    mixed = F.when(F.col("lang") == "fr", F.concat(F.lit("x"), number)).otherwise(number)
    return profile.clustered(meta(spark, folder).withColumn("cluster", mixed)).select("row_id", "lang")


@query(
    "coerce_numeric",
    """SELECT doc_id, try_cast(substr(source, 4) AS DOUBLE) AS "src_Count", try_cast(lang AS DOUBLE) AS "lang_Percent",
  CAST(n_chars AS DOUBLE) AS "Difference", source FROM documents""",
)
def coerce_numeric(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", F.expr("substr(source, 4)").alias("src_Count"), F.col("lang").alias("lang_Percent"),
        F.col("n_chars").cast("string").alias("Difference"), "source",
    )
    return coerce_comparison(docs)


@query("unpivot_counts", _with(*THREE_LONG) + 'SELECT cluster AS "Cluster_ID", grp, n FROM shares')
def unpivot_counts(spark, folder):
    _, clusters, counts, totals = _three(spark, folder)
    return profile.unpivot_counts(compare.proportions(counts, clusters, totals), ["Cluster_ID"])


@query("row_ids", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents")
def row_ids(spark, folder):
    """Documents are stored in doc_id order; ids follow the file."""
    return with_row_id(table(spark, folder, "documents")).select("doc_id", "row_id")


@query(
    "hash_sample",
    """SELECT l_orderkey, l_linenumber FROM (
  SELECT l_orderkey, l_linenumber, md5(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) || ':42') AS h FROM lineitem)
ORDER BY h LIMIT 1000""",
)
def sampled(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    keyed = lines.withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return hash_sample(keyed, "row_id", 1000).select("l_orderkey", "l_linenumber")
