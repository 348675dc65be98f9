"""Readers and writers, choices of columns and groups, and the fixed output set."""

from __future__ import annotations

from pyspark.sql import functions as F

from themescope.catalog.comparing import CONV_CLUSTERS, TWO, _counts, _grid, _sizes, _wide, _with
from themescope.catalog.registry import (
    CONV,
    SQL,
    STOP_SQL,
    conv,
    conv_clusters,
    meta,
    query,
    r6,
    rounded,
    strip_sql,
    table,
    words_sql,
)
from themescope.operators import compare, profile
from themescope.operators.summary import by_size, cluster_summary
from themescope.plans.report import JobMetrics, comparison_lines, run_outputs
from themescope.plans.steps import compare_step
from themescope.session import shared_path
from themescope.sources.lexicon import read_lexicon
from themescope.sources.tables import (
    load_chosen_k,
    read_outside_csv,
    rename_legacy,
    save_chosen_k,
    write_csv,
    write_lines,
)
from themescope.sources.text_csv import preview, read_text_csv


@query(
    "csv_scan",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, CAST(n_chars AS VARCHAR) AS n_chars,
  md5(coalesce(text, '')) AS digest FROM documents""",
)
def csv_scan(spark, folder):
    """All documents through a CSV with quotes and line breaks, read back as strings."""
    path = shared_path(spark, "csv")
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    docs.write.csv(
        path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    rows = read_text_csv(spark, path, multi_line=True)
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5(text).alias("digest"))


@query("csv_row_ids", "SELECT doc_id - min(doc_id) OVER () AS row_id, doc_id FROM documents")
def csv_row_ids(spark, folder):
    """Row ids of a CSV whose files follow the document ids, read in splits."""
    path = shared_path(spark, "csv")
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    docs.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.csv(path, header=True)
    return read_text_csv(spark, path).select("row_id", F.col("doc_id").cast("bigint").alias("doc_id"))


@query(
    "preview_rows",
    "SELECT count(*) AS n, count(DISTINCT doc_id) AS n_ids FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5)",
)
def preview_rows(spark, folder):
    return preview(table(spark, folder, "documents"), 5).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_ids")
    )


@query(
    "text_column_choice",
    """SELECT name FROM (
  SELECT 'doc_id' AS name, bool_or(try_cast(CAST(doc_id AS VARCHAR) AS DOUBLE) IS NULL) AS is_text FROM documents
  UNION ALL SELECT 'n_chars', bool_or(try_cast(CAST(n_chars AS VARCHAR) AS DOUBLE) IS NULL) FROM documents
  UNION ALL SELECT 'text', bool_or(try_cast(text AS DOUBLE) IS NULL) FROM documents) WHERE is_text""",
)
def text_column_choice(spark, folder):
    name = profile.detect_text_column(table(spark, folder, "documents").select("doc_id", "n_chars", "text"))
    return spark.createDataFrame([(name,)], "name string")


@query("text_column_alias", "SELECT conv_id, turn, md5(text) AS digest FROM conversations")
def text_column_alias(spark, folder):
    """Texts found under the older column name."""
    rows = table(spark, folder, "conversations").withColumnRenamed("text", "Message")
    return rows.select("conv_id", "turn", F.md5(profile.text_column_name(rows)).alias("digest"))


@query(
    "quick_category_columns",
    """WITH head AS (SELECT * FROM documents ORDER BY doc_id LIMIT 1000)
SELECT name FROM (SELECT 'lang' AS name, count(DISTINCT lang) AS n FROM head
  UNION ALL SELECT 'source', count(DISTINCT source) FROM head
  UNION ALL SELECT 'n_chars', count(DISTINCT n_chars) FROM head
  UNION ALL SELECT 'doc_id', count(DISTINCT doc_id) FROM head) WHERE n <= 50""",
)
def quick_category_columns(spark, folder):
    found = profile.compare_columns_quick(table(spark, folder, "documents").orderBy("doc_id"))
    return spark.createDataFrame([(c,) for c in found], "name string")


@query(
    "group_column_choice",
    """SELECT name FROM (SELECT 'source' AS name, count(DISTINCT source) AS n FROM documents
  UNION ALL SELECT 'n_chars', count(DISTINCT n_chars) FROM documents
  UNION ALL SELECT 'doc_id', count(DISTINCT doc_id) FROM documents) WHERE n BETWEEN 2 AND 50""",
)
def group_column_choice(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "source", "n_chars", "text")
    return spark.createDataFrame([(profile.choose_group_column(rows),)], "name string")


@query(
    "asked_groups",
    """WITH asked AS (SELECT trim(x) AS grp, min(i) AS first FROM (
    SELECT unnest(string_split(' user,assistant , user,system', ',')) AS x, generate_subscripts(string_split(' user,assistant , user,system', ','), 1) AS i)
  GROUP BY trim(x))
SELECT grp, row_number() OVER (ORDER BY first) AS place FROM asked
WHERE grp IN (SELECT role FROM conversations)""",
)
def asked_groups(spark, folder):
    names = profile.select_groups(table(spark, folder, "conversations"), "role", [" user,assistant ", " user,system"])
    return spark.createDataFrame(list(zip(names, range(1, len(names) + 1))), "grp string, place bigint")


@query(
    "legacy_names",
    """SELECT label AS "Cluster_ID", 'T' || CAST(label AS VARCHAR) AS "Cluster_Label", count(*) AS n
FROM embeddings GROUP BY label""",
)
def legacy_names(spark, folder):
    old = table(spark, folder, "embeddings").groupBy(F.col("label").alias("Topic_ID")).agg(F.count(F.lit(1)).alias("n"))
    named = old.withColumn("Topic_Label", F.concat(F.lit("T"), F.col("Topic_ID").cast("string")))
    return rename_legacy(named)


_NONE = "SELECT * FROM clusters WHERE cluster < 0"


@query(
    "empty_clusters",
    _with(CONV, CONV_CLUSTERS, _counts("conv", "role", TWO))
    + """SELECT 'listed' AS clusters, count(*) AS n_lines FROM clusters
UNION ALL SELECT 'none', count(*) FROM ("""
    + _NONE
    + ")",
)
def empty_clusters(spark, folder):
    """The comparison of all clusters and of none has the same columns."""
    rows = conv(spark, folder)
    counts, clusters = compare.cells(rows, "role", TWO), conv_clusters(rows)
    totals = compare.totals_of(counts, TWO)
    some = compare.z_tests(compare.proportions(counts, clusters, totals), totals)
    none = compare.z_tests(compare.proportions(counts, clusters.where("cluster < 0"), totals), totals)
    if some.columns != none.columns:
        raise ValueError("columns differ")
    lines = [t.agg(F.count(F.lit(1)).alias("n_lines")) for t in (some, none)]
    return lines[0].select(F.lit("listed").alias("clusters"), "n_lines").union(
        lines[1].select(F.lit("none").alias("clusters"), "n_lines")
    )


@query(
    "job_metrics",
    'SELECT count(*) AS "rows", count(CASE WHEN length(text) < 50 THEN 1 END) AS failed FROM documents',
)
def job_metrics(spark, folder):
    marked = table(spark, folder, "documents").withColumn("failed", F.length("text") < 50)
    job = JobMetrics(marked)
    job.df.write.format("noop").mode("overwrite").save()
    found = job.result()
    return spark.createDataFrame([(found["rows"], found["failed"])], "rows bigint, failed bigint")


@query("chosen_k_store", "SELECT CAST(count(DISTINCT source) AS INTEGER) AS k FROM documents")
def chosen_k_store(spark, folder):
    path = shared_path(spark, "k")
    if load_chosen_k(spark, path) is not None:
        raise ValueError("a new path holds a k")
    k = table(spark, folder, "documents").agg(F.count_distinct("source")).first()[0]
    save_chosen_k(spark, k, path)
    return spark.createDataFrame([(load_chosen_k(spark, path),)], "k int")


@query(
    "comparison_csv",
    _with(CONV, CONV_CLUSTERS, _counts("conv", "role", TWO), _grid(TWO), _wide(TWO))
    + f"""SELECT "Cluster_Label", CAST("Cluster_ID" AS INTEGER) AS "Cluster_ID", CAST("user_Count" AS INTEGER) AS "user_Count",
  CAST("assistant_Count" AS INTEGER) AS "assistant_Count", {r6('"user_Percent"')} AS "user_Percent" FROM wide""",
)
def comparison_csv(spark, folder):
    """The comparison table through its CSV file, with the byte order mark."""
    rows = conv(spark, folder)
    counts = compare.cells(rows, "role", TWO)
    path = shared_path(spark, "csv")
    write_csv(compare.proportions(counts, conv_clusters(rows), compare.totals_of(counts, TWO)), path)
    back = read_outside_csv(spark, path)
    back = back.toDF(*[c.lstrip("﻿") for c in back.columns])
    return rounded(back.select("Cluster_Label", "Cluster_ID", "user_Count", "assistant_Count", "user_Percent"), "user_Percent")


@query(
    "cluster_output",
    _with("sized AS (SELECT coalesce(e.label, -1) AS cluster FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)")
    + """SELECT CAST(cluster AS INTEGER) AS "Cluster_ID", CAST(count(*) AS INTEGER) AS "Message_Count" FROM sized
WHERE cluster >= 0 GROUP BY cluster""",
)
def cluster_output(spark, folder):
    """The summary, largest cluster first, through its CSV file."""
    path = shared_path(spark, "csv")
    write_csv(by_size(_sizes(meta(spark, folder))), path, bom=False)
    return read_outside_csv(spark, path).select("Cluster_ID", "Message_Count")


@query(
    "report_file",
    "SELECT line, count(*) AS n FROM (" + SQL["comparison_report"] + ") GROUP BY line",
)
def report_file(spark, folder):
    """The comparison report through its text file."""
    rows = conv(spark, folder)
    path = shared_path(spark, "report")
    write_lines(comparison_lines(compare_step(rows, conv_clusters(rows), "role", TWO)), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "lexicon_scan",
    """WITH d AS (SELECT source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)
SELECT DISTINCT 'whole' AS file, 'negative' AS side, source AS word FROM d
UNION SELECT 'whole', 'positive', lang FROM d
UNION ALL SELECT 'broken', 'negative', 'bad' UNION ALL SELECT 'broken', 'positive', 'good'""",
)
def lexicon_scan(spark, folder):
    """A lexicon of the documents' sources and languages, written, read back; and one cut off in the middle."""
    docs = table(spark, folder, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    padded = F.concat(F.lit("  "), F.col("lang"), F.lit("\t"))  # blanks around a word do not count
    lists = docs.agg(F.collect_set("source").alias("negative"), F.collect_set(padded).alias("positive"))
    whole = lists.select(F.to_json(F.struct(F.struct("negative", "positive").alias("sentiment_words"))).alias("value"))
    broken = whole.select(F.expr("left(value, length(value) DIV 2)").alias("value"))
    found = []
    for name, text in (("whole", whole), ("broken", broken)):
        path = shared_path(spark, "lexicon")
        text.coalesce(1).write.text(path)  # one line
        words = read_lexicon(spark, path)
        found += [(name, side, w) for side in ("negative", "positive") for w in getattr(words, side)]
    return spark.createDataFrame(found, "file string, side string, word string")


_NUMBER = "(SELECT count(*) FROM clusters)"
_ROWS = {
    "cluster_comparison": _NUMBER,
    "clusters_with_labels": "(SELECT count(DISTINCT cluster) FROM msgs)",
    "comparison_report": f"(SELECT count(*) FROM ({SQL['comparison_report']}))",
    "overview_report": f"(SELECT count(*) FROM ({SQL['overview_report']}))",
    "cluster_sizes": "(SELECT least(25, count(DISTINCT cluster)) FROM msgs)",
    "cluster_proportions_pie": "(SELECT CASE WHEN count(DISTINCT cluster) > 10 THEN 11 ELSE count(DISTINCT cluster) END FROM msgs)",
    "cluster_heatmap": f"least(20, {_NUMBER})",
    "cluster_mix_stacked_bar": f"{len(TWO)} * CASE WHEN {_NUMBER} > 10 THEN 11 ELSE {_NUMBER} END",
    "cluster_facets": f"{len(TWO)} * least(12, {_NUMBER})",
    "cluster_treemap": _NUMBER,
    "cluster_sankey": f"""(SELECT count(*) FROM (SELECT DISTINCT cluster, role FROM conv WHERE role IN {tuple(TWO)}
      AND cluster IN (SELECT cluster FROM conv WHERE role IN {tuple(TWO)} GROUP BY cluster ORDER BY count(*) DESC, cluster LIMIT 20)))""",
    "cluster_comparison_chart": f"least(15, {_NUMBER})",
    "cluster_differences_chart": f"(SELECT count(*) FROM ({SQL['difference_chart']}))",
    "wordcloud": f"""(SELECT sum(least(100, n)) FROM (SELECT role, count(DISTINCT word) AS n
      FROM (SELECT role, unnest({words_sql('text')}) AS word FROM conv) WHERE word NOT IN {STOP_SQL} GROUP BY role))""",
}


@query(
    "output_set",
    _with(CONV, CONV_CLUSTERS, f"msgs AS (SELECT * FROM conv WHERE cluster >= 0 AND length({strip_sql('text')}) > 0)")
    + " UNION ALL ".join(f"SELECT '{name}' AS name, true AS ok, CAST({n} AS BIGINT) AS n_rows" for name, n in _ROWS.items())
    + " UNION ALL SELECT 'broken', false, NULL",
)
def output_set(spark, folder):
    """Every output of a comparison is written and read back; one broken item does not stop the rest."""
    rows = conv(spark, folder)
    done = compare_step(rows, conv_clusters(rows), "role", TWO)

    def broken():
        raise RuntimeError("on purpose")

    out = shared_path(spark, "outputs")
    status = run_outputs(done, cluster_summary(rows), rows, out, {"broken": broken}).select("name", "ok").collect()
    found = []
    for name, ok in status:  # the fixed list of outputs
        path = f"{out}/{name}"
        if not ok:
            n = None
        elif name.endswith("_report"):
            n = spark.read.text(path).count()
        elif name in ("cluster_comparison", "clusters_with_labels"):
            n = spark.read.csv(path, header=True, multiLine=True, escape='"').count()
        else:
            n = spark.read.parquet(path).count()
        found.append((name, ok, n))
    return spark.createDataFrame(found, "name string, ok boolean, n_rows bigint")
