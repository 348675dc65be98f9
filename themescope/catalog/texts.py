"""Sentiment, keywords, labels and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from themescope.catalog.comparing import _with
from themescope.catalog.registry import CONV, META, STOP_SQL, conv, meta, query, strip_sql, table, words_sql
from themescope.functions.text import WHITESPACE, clean_label, column_safe, file_safe, prompt_line, title_label
from themescope.functions.words import NEGATIVE, POSITIVE
from themescope.operators import keywords as kw
from themescope.operators import summary
from themescope.operators.reduce import with_sentiment


def _any(tokens):
    return " OR ".join(f"contains(lower({strip_sql('text')}), '{t}')" for t in tokens)


SENTIMENT = f"CASE WHEN text IS NULL THEN 0 WHEN {_any(NEGATIVE)} THEN -1 WHEN {_any(POSITIVE)} THEN 1 ELSE 0 END"


@query("sentiment", f"SELECT doc_id, {SENTIMENT} AS sentiment FROM documents")
def sentiment(spark, folder):
    return with_sentiment(table(spark, folder, "documents")).select("doc_id", "sentiment")


@query("sentiment_tallies", f"SELECT {SENTIMENT} AS sentiment, count(*) AS n FROM documents GROUP BY ALL")
def sentiment_tallies(spark, folder):
    scored = with_sentiment(table(spark, folder, "documents"))
    return scored.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))


def _keyword_ctes(rows):
    return f"""msgs AS (SELECT cluster, row_id, {strip_sql('text')} AS text FROM {rows}
  WHERE cluster >= 0 AND length({strip_sql('text')}) > 0),
tokens AS (SELECT cluster, row_id, unnest(w) AS word, unnest(range(len(w))) AS pos
  FROM (SELECT cluster, row_id, {words_sql('text')} AS w FROM msgs)),
tops AS (SELECT cluster, word, count(*) AS n, row_number() OVER (
    PARTITION BY cluster ORDER BY count(*) DESC, min(row_id * 1000000 + pos)) AS place
  FROM tokens WHERE word NOT IN {STOP_SQL} GROUP BY cluster, word QUALIFY place <= 5)"""


@query("keywords", _with(META, _keyword_ctes("meta")) + "SELECT cluster, place AS rank, word, n FROM tops")
def keywords(spark, folder):
    top = kw.top_keywords(summary.messages(meta(spark, folder)))
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "word_freq",
    _with(
        META,
        f"tokens AS (SELECT lang AS grp, unnest({words_sql('text')}) AS word FROM meta)",
        f"""tops AS (SELECT grp, word, count(*) AS n, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, word) AS rank
  FROM tokens WHERE word NOT IN {STOP_SQL} GROUP BY grp, word QUALIFY rank <= 100)""",
    )
    + "SELECT grp, rank, word, n FROM tops",
)
def word_freq(spark, folder):
    return kw.word_freq(meta(spark, folder), "lang").withColumn("rank", F.col("rank").cast("bigint"))


LABELS = """ids AS (SELECT DISTINCT cluster FROM msgs),
named AS (SELECT i.cluster, COALESCE(string_agg(CASE WHEN t.place <= 3
    THEN upper(substr(t.word, 1, 1)) || substr(t.word, 2) END, ' / ' ORDER BY t.place),
    'Cluster ' || CAST(i.cluster + 1 AS VARCHAR)) AS label,
    COALESCE(string_agg(t.word, ', ' ORDER BY t.place), '') AS keywords
  FROM ids i LEFT JOIN tops t ON t.cluster = i.cluster GROUP BY i.cluster)"""


@query(
    "fallback_label", _with(CONV, _keyword_ctes("conv"), LABELS) + "SELECT cluster, label FROM named"
)
def fallback_label(spark, folder):
    msgs = summary.messages(conv(spark, folder))
    lists = kw.keyword_lists(kw.top_keywords(msgs))
    joined = msgs.select("cluster").distinct().join(lists, "cluster", "left")
    words = F.coalesce("keywords", F.array().cast("array<string>"))
    return joined.select("cluster", title_label(words, F.col("cluster")).alias("label"))


@query(
    "label_cleanup",
    _with(CONV)
    + f"""SELECT row_id, array_to_string(list_slice(regexp_split_to_array(
  {strip_sql("replace(replace(text, chr(34), ''), chr(39), '')")}, '[{WHITESPACE}]+'), 1, 4), ' ') AS label FROM conv""",
)
def label_cleanup(spark, folder):
    return conv(spark, folder).select("row_id", clean_label(F.col("text")).alias("label"))


@query(
    "safe_names",
    """SELECT doc_id, replace(source || ' ' || lang, ' ', '_') AS column_name,
  md5(regexp_replace(text, '[^\\p{L}\\p{N}_\\-]', '_', 'g')) AS digest FROM documents""",
)
def safe_names(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        column_safe(F.concat_ws(" ", "source", "lang")).alias("column_name"),
        F.md5(file_safe(F.col("text"))).alias("digest"),
    )


@query("prompt_lines", _with(CONV) + "SELECT row_id, '- ' || left(text, 200) AS line FROM conv")
def prompt_lines(spark, folder):
    return conv(spark, folder).select("row_id", prompt_line(F.col("text")).alias("line"))


def _picks(rows):
    return f"""msgs AS (SELECT cluster, row_id, {strip_sql('text')} AS text FROM {rows}
  WHERE cluster >= 0 AND length({strip_sql('text')}) > 0),
plan AS (SELECT cluster, count(*) AS n_all, count(*) FILTER (length(text) BETWEEN 20 AND 200) AS n_fit
  FROM msgs GROUP BY cluster),
pool AS (SELECT m.*, p.n_all, row_number() OVER (PARTITION BY m.cluster ORDER BY row_id) - 1 AS i,
    count(*) OVER (PARTITION BY m.cluster) AS n_pool
  FROM msgs m JOIN plan p ON p.cluster = m.cluster
  WHERE p.n_all <= 8 OR p.n_fit < 8 OR length(m.text) BETWEEN 20 AND 200),
keyed AS (SELECT *, CASE WHEN n_all <= 8 THEN row_id WHEN i = 0 THEN 0
    WHEN i = n_pool // 2 AND n_pool > 2 THEN 1 WHEN i = n_pool - 1 THEN 2 ELSE 3 END AS o,
    md5(CAST(row_id AS VARCHAR) || ':42') AS h FROM pool),
picks AS (SELECT cluster, row_id, text, row_number() OVER (PARTITION BY cluster ORDER BY o,
    CASE WHEN n_all <= 8 THEN '' ELSE h END) AS place FROM keyed QUALIFY place <= 8)"""


def _places(df):
    return df.withColumn("place", F.col("place").cast("bigint"))


@query("representatives", _with(CONV, _picks("conv")) + "SELECT cluster, row_id, place FROM picks")
def representatives(spark, folder):
    msgs = summary.messages(conv(spark, folder))
    return _places(summary.representatives(msgs).select("cluster", "row_id", "place"))


@query("representatives_long", _with(META, _picks("meta")) + "SELECT cluster, row_id, place FROM picks")
def representatives_long(spark, folder):
    """Mostly long texts: too few fit the preferred length."""
    msgs = summary.messages(meta(spark, folder))
    return _places(summary.representatives(msgs).select("cluster", "row_id", "place"))


@query(
    "label_prompts",
    _with(CONV, _picks("conv"))
    + "SELECT cluster, string_agg('- ' || left(text, 200), chr(10) ORDER BY place) AS prompt_lines FROM picks GROUP BY cluster",
)
def label_prompts(spark, folder):
    return summary.label_prompts(summary.representatives(summary.messages(conv(spark, folder))))


FIRST5 = """firsts AS (SELECT cluster, string_agg(text, ' | ' ORDER BY row_id) AS samples FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY row_id) AS place FROM msgs) WHERE place <= 5 GROUP BY cluster)"""


@query(
    "sample_messages",
    _with(CONV, _keyword_ctes("conv"), FIRST5) + "SELECT cluster, samples FROM firsts",
)
def sample_messages(spark, folder):
    return summary.sample_messages(summary.messages(conv(spark, folder)))


CLASHING = """clashing AS (SELECT cluster, CASE WHEN cluster % 2 = 0 THEN 'Theme ' ELSE 'theme ' END
    || CAST(cluster % 3 AS VARCHAR) AS label
  FROM (SELECT DISTINCT CAST(substr(source, 4) AS INTEGER) AS cluster FROM documents))"""


@query(
    "label_dedup",
    _with(CLASHING)
    + """SELECT cluster, CASE WHEN k = 0 THEN label ELSE label || ' (' || CAST(k AS VARCHAR) || ')' END AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(label) ORDER BY cluster) - 1 AS k FROM clashing)""",
)
def label_dedup(spark, folder):
    ids = table(spark, folder, "documents").select(F.expr("CAST(substr(source, 4) AS INT)").alias("cluster")).distinct()
    start = F.when(F.col("cluster") % 2 == 0, "Theme ").otherwise("theme ")
    return summary.dedup_labels(
        ids.withColumn("label", F.concat(start, (F.col("cluster") % 3).cast("string")))
    )


@query(
    "cluster_summary",
    _with(
        META, _keyword_ctes("meta"), LABELS, FIRST5,
        """unique_names AS (SELECT *, row_number() OVER (PARTITION BY lower(label) ORDER BY cluster) - 1 AS k FROM named),
sizes AS (SELECT cluster, count(*) AS n FROM msgs GROUP BY cluster)""",
    )
    + """SELECT s.cluster AS "Cluster_ID",
  CASE WHEN u.k = 0 THEN u.label ELSE u.label || ' (' || CAST(u.k AS VARCHAR) || ')' END AS "Cluster_Label",
  u.keywords AS "Top_Keywords", s.n AS "Message_Count", md5(f.samples) AS "Sample_Messages"
FROM sizes s JOIN unique_names u ON u.cluster = s.cluster JOIN firsts f ON f.cluster = s.cluster""",
)
def cluster_summary(spark, folder):
    out = summary.cluster_summary(meta(spark, folder))
    return out.withColumn("Sample_Messages", F.md5("Sample_Messages"))


@query(
    "category_counts",
    _with(META)
    + " UNION ALL ".join(
        f"SELECT cluster, '{c}' AS col, {strip_sql(c)} AS val, count(*) AS n FROM meta "
        f"WHERE cluster >= 0 AND length({strip_sql(c)}) > 0 GROUP BY ALL"
        for c in ("lang", "source", "quality")
    ),
)
def category_counts(spark, folder):
    return summary.category_counts(meta(spark, folder), ["lang", "source", "quality"])


_VALUES = [("lang", "en"), ("lang", "fr"), ("quality", "0"), ("quality", "1")]


@query(
    "category_counts_wide",
    _with(META)
    + "SELECT cluster, "
    + ", ".join(f"count(*) FILTER ({c} = '{v}') AS \"{c}__{v}_Count\"" for c, v in _VALUES)
    + " FROM meta WHERE cluster >= 0 GROUP BY cluster",
)
def category_counts_wide(spark, folder):
    long = summary.category_counts(meta(spark, folder), ["lang", "quality"])
    return summary.category_counts_wide(long, _VALUES)


@query(
    "cluster_tallies",
    _with(META)
    + """SELECT count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS n_clusters,
  CAST(count(*) FILTER (cluster < 0) AS BIGINT) AS n_noise, CAST(count(*) FILTER (cluster >= 0) AS BIGINT) AS n_assigned FROM meta""",
)
def cluster_tallies(spark, folder):
    return summary.tallies(meta(spark, folder))
