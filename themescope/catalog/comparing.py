"""Comparison statistics and the tables behind the charts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from themescope.catalog.registry import (
    CLUSTERS,
    CONV,
    META,
    conv,
    conv_clusters,
    erf_sql,
    meta,
    query,
    r6,
    rounded,
    strip_sql,
    table,
)
from themescope.operators import charts, compare
from themescope.operators.profile import group_values
from themescope.operators.summary import by_size
from themescope.plans.steps import compare_step
from themescope.session import cut_lineage

TWO = ["user", "assistant"]
THREE = ["user", "assistant", "system"]


def _in(groups):
    return "(" + ", ".join(f"'{g}'" for g in groups) + ")"


def _counts(rows, group, groups=None, name="counts"):
    where = f"WHERE {strip_sql(group)} IN {_in(groups)}" if groups else ""
    return f"""{name} AS (
  SELECT cluster, {strip_sql(group)} AS grp, count(*) AS n FROM {rows} {where} GROUP BY ALL)"""


def _grid(groups=None):
    """One line per listed cluster and group, with percent of the group; all groups if none are named."""
    names = " UNION ALL ".join(f"SELECT '{g}' AS grp, {i} AS grp_ord" for i, g in enumerate(groups or []))
    names = names or "SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS grp_ord FROM (SELECT DISTINCT grp FROM counts WHERE grp IS NOT NULL)"
    return f"""names AS ({names}),
totals AS (SELECT grp, sum(n) AS n_group FROM counts GROUP BY grp),
shares AS (
  SELECT c.cluster, c.label, g.grp, g.grp_ord, CAST(COALESCE(k.n, 0) AS BIGINT) AS n,
         CASE WHEN t.n_group > 0 THEN COALESCE(k.n, 0) / CAST(t.n_group AS DOUBLE) * 100 ELSE 0.0 END AS pct
  FROM clusters c CROSS JOIN names g LEFT JOIN totals t ON t.grp = g.grp
  LEFT JOIN counts k ON k.cluster = c.cluster AND k.grp = g.grp)"""


def _wide(groups):
    counts = ", ".join(f"CAST(sum(CASE WHEN grp = '{g}' THEN n END) AS BIGINT) AS \"{g}_Count\"" for g in groups)
    pcts = ", ".join(f"sum(CASE WHEN grp = '{g}' THEN pct END) AS \"{g}_Percent\"" for g in groups)
    diff = ""
    if len(groups) == 2:
        a, b = groups
        diff = f", sum(CASE WHEN grp = '{a}' THEN pct END) - sum(CASE WHEN grp = '{b}' THEN pct END) AS \"Difference\""
    return f"""wide AS (
  SELECT label AS "Cluster_Label", cluster AS "Cluster_ID", {counts}, {pcts}{diff}
  FROM shares GROUP BY cluster, label)"""


def _tested(groups):
    a, b = groups
    return f"""pair AS (
  SELECT w.*, CAST((SELECT n_group FROM totals WHERE grp = '{a}') AS DOUBLE) AS n1,
         CAST((SELECT n_group FROM totals WHERE grp = '{b}') AS DOUBLE) AS n2 FROM wide w),
errors AS (
  SELECT *, "{a}_Count" / n1 AS p1, "{b}_Count" / n2 AS p2,
         ("{a}_Count" + "{b}_Count") / (n1 + n2) AS pp FROM pair),
scored AS (
  SELECT *, nullif(sqrt(pp * (1 - pp) * (1 / n1 + 1 / n2)), 0) AS se FROM errors),
tested AS (
  SELECT *, (p1 - p2) / se AS z, 1.959963984540054 * se AS me FROM scored),
tests AS (
  SELECT "Cluster_Label", "Cluster_ID", "{a}_Count", "{b}_Count", "{a}_Percent", "{b}_Percent", "Difference",
         z AS "Z_Score", greatest(0.0, 1 - {erf_sql("abs(z) / sqrt(2.0)")}) AS "P_Value",
         (p1 - p2 - me) * 100 AS "CI_Lower", (p1 - p2 + me) * 100 AS "CI_Upper" FROM tested)"""


def _expected(groups=None):
    names = " UNION ALL ".join(f"SELECT '{g}' AS grp" for g in groups or []) or "SELECT DISTINCT grp FROM counts"
    return f"""known AS (SELECT * FROM counts WHERE cluster IS NOT NULL),
rowsum AS (SELECT cluster, sum(n) AS r FROM known GROUP BY cluster),
colsum AS (SELECT grp, sum(n) AS c FROM known GROUP BY grp),
grand AS (SELECT sum(n) AS total FROM known),
grid AS (
  SELECT rowsum.cluster, colsum.grp, CAST(COALESCE(k.n, 0) AS BIGINT) AS observed,
         CAST(r AS DOUBLE) * CAST(c AS DOUBLE) / total AS expected
  FROM rowsum CROSS JOIN colsum CROSS JOIN grand
  LEFT JOIN known k ON k.cluster = rowsum.cluster AND k.grp = colsum.grp
  WHERE colsum.grp IN (SELECT grp FROM ({names}))),
residuals AS (SELECT *, (observed - expected) / sqrt(expected) AS residual FROM grid)"""


def _chi():
    tail = f"""CASE WHEN dof <= 0 OR chi2 <= 0 THEN 1.0
    WHEN dof % 2 = 0 THEN list_sum(list_transform(range(0, CAST(dof / 2 AS BIGINT)),
      lambda i: exp(-chi2 / 2 + i * ln(chi2 / 2) - lgamma(i + 1.0))))
    ELSE 1 - {erf_sql("sqrt(chi2 / 2)")} + COALESCE(list_sum(list_transform(range(1, CAST((dof - 1) / 2 AS BIGINT) + 1),
      lambda i: exp(-chi2 / 2 + (i - 0.5) * ln(chi2 / 2) - lgamma(i + 0.5)))), 0) END"""
    return f"""parts AS (
  SELECT (count(DISTINCT cluster) - 1) * (count(DISTINCT grp) - 1) AS dof,
         sum((observed - expected) ^ 2 / expected) AS plain,
         sum((abs(observed - expected) - least(0.5, abs(observed - expected))) ^ 2 / expected) AS yates FROM grid),
chi AS (SELECT CASE WHEN dof = 0 THEN 0.0 WHEN dof = 1 THEN yates ELSE plain END AS chi2, dof FROM parts),
answer AS (SELECT chi2, least(1.0, greatest(0.0, {tail})) AS p_value, dof FROM chi)"""


def _with(*parts):
    return "WITH " + ",\n".join(parts) + "\n"


CONV_CLUSTERS = CLUSTERS.format(rows="conv")
META_CLUSTERS = CLUSTERS.format(rows="meta")
TWO_WIDE = [CONV, CONV_CLUSTERS, _counts("conv", "role", TWO), _grid(TWO), _wide(TWO)]
THREE_LONG = [CONV, CONV_CLUSTERS, _counts("conv", "role", THREE), _grid(THREE)]


def _two(spark, folder):
    rows = conv(spark, folder)
    counts = cut_lineage(compare.cells(rows, "role", TWO))
    return rows, conv_clusters(rows), counts, compare.totals_of(counts, TWO)


def _three(spark, folder):
    rows = conv(spark, folder)
    counts = cut_lineage(compare.cells(rows, "role", THREE))
    return rows, conv_clusters(rows), counts, compare.totals_of(counts, THREE)


def _tested_two(spark, folder):
    _, clusters, counts, totals = _two(spark, folder)
    return compare.z_tests(compare.proportions(counts, clusters, totals), totals)


def _shares_three(spark, folder):
    _, clusters, counts, totals = _three(spark, folder)
    return compare.shares(counts, clusters, totals)


@query("group_totals", _with(META) + f"SELECT {strip_sql('lang')} AS grp, count(*) AS n_group FROM meta GROUP BY ALL")
def group_totals(spark, folder):
    rows = meta(spark, folder)
    return compare.group_totals(_all_cells(rows, "lang"))


def _all_cells(rows, group_col):
    groups = [r["grp"] for r in group_values(rows, group_col).collect()]
    return compare.cells(rows, group_col, groups)


@query(
    "group_totals_clustered",
    _with(META) + "SELECT lang AS grp, count(*) AS n_group_clustered FROM meta WHERE cluster >= 0 GROUP BY lang",
)
def group_totals_clustered(spark, folder):
    return compare.clustered_group_totals(_all_cells(meta(spark, folder), "lang"))


@query("cluster_totals", _with(META) + "SELECT cluster, count(*) AS n_cluster FROM meta GROUP BY cluster")
def cluster_totals(spark, folder):
    return compare.cluster_totals(_all_cells(meta(spark, folder), "source"))


PERCENTS2 = ", ".join(f'{r6(chr(34) + g + "_Percent" + chr(34))} AS "{g}_Percent"' for g in TWO)
PERCENTS3 = ", ".join(f'{r6(chr(34) + g + "_Percent" + chr(34))} AS "{g}_Percent"' for g in THREE)


@query(
    "proportions",
    _with(CONV, CONV_CLUSTERS, _counts("conv", "role", THREE), _grid(THREE), _wide(THREE))
    + 'SELECT "Cluster_Label", "Cluster_ID", '
    + ", ".join(f'"{g}_Count"' for g in THREE)
    + f", {PERCENTS3} FROM wide",
)
def proportions(spark, folder):
    _, clusters, counts, totals = _three(spark, folder)
    wide = compare.proportions(counts, clusters, totals)
    return rounded(wide, *[f"{g}_Percent" for g in THREE])


@query(
    "pct_difference",
    _with(*TWO_WIDE) + f'SELECT "Cluster_ID", {PERCENTS2}, {r6(chr(34) + "Difference" + chr(34))} AS "Difference" FROM wide',
)
def pct_difference(spark, folder):
    _, clusters, counts, totals = _two(spark, folder)
    wide = compare.proportions(counts, clusters, totals)
    return rounded(
        wide.select("Cluster_ID", "user_Percent", "assistant_Percent", "Difference"),
        "user_Percent", "assistant_Percent", "Difference",
    )


TESTS = ", ".join(
    f'{r6(chr(34) + c + chr(34))} AS "{c}"' for c in ("Difference", "Z_Score", "P_Value", "CI_Lower", "CI_Upper")
)
TEST_NAMES = ("Difference", "Z_Score", "P_Value", "CI_Lower", "CI_Upper")


@query("z_tests", _with(*TWO_WIDE, _tested(TWO)) + f'SELECT "Cluster_ID", {TESTS} FROM tests')
def z_tests(spark, folder):
    return rounded(_tested_two(spark, folder).select("Cluster_ID", *TEST_NAMES), *TEST_NAMES)


@query(
    "z_tests_or_null",
    _with(*THREE_LONG)
    + """SELECT cluster AS "Cluster_ID", CAST(NULL AS DOUBLE) AS "Z_Score", CAST(NULL AS DOUBLE) AS "P_Value",
       CAST(NULL AS DOUBLE) AS "CI_Lower", CAST(NULL AS DOUBLE) AS "CI_Upper" FROM clusters""",
)
def z_tests_or_null(spark, folder):
    _, clusters, counts, totals = _three(spark, folder)
    tested = compare.z_tests(compare.proportions(counts, clusters, totals), totals)
    return tested.select("Cluster_ID", "Z_Score", "P_Value", "CI_Lower", "CI_Upper")


@query(
    "comparison_sorted",
    _with(*TWO_WIDE)
    + f"""SELECT "Cluster_ID", row_number() OVER (ORDER BY abs("Difference") DESC, "Cluster_ID") AS place,
       {r6('"Difference"')} AS "Difference" FROM wide ORDER BY place""",
)
def comparison_sorted(spark, folder):
    """Place taken from the ordered result itself."""
    _, clusters, counts, totals = _two(spark, folder)
    table = compare.ordered(compare.proportions(counts, clusters, totals), TWO)
    numbered = table.withColumn("_seq", F.monotonically_increasing_id())
    return rounded(numbered.select("Cluster_ID", _place().alias("place"), "Difference"), "Difference")


def _place():
    return F.row_number().over(W.orderBy("_seq")).cast("bigint")


@query(
    "crosstab",
    _with(META, _counts("meta", "quality", ["0", "1"]))
    + """SELECT c.cluster, g.grp, CAST(COALESCE(k.n, 0) AS BIGINT) AS observed
FROM (SELECT DISTINCT cluster FROM counts) c CROSS JOIN (SELECT '0' AS grp UNION ALL SELECT '1') g
LEFT JOIN counts k ON k.cluster = c.cluster AND k.grp = g.grp""",
)
def crosstab(spark, folder):
    return compare.crosstab(compare.cells(meta(spark, folder), "quality", ["0", "1"]), ["0", "1"])


@query(
    "std_residuals",
    _with(CONV, _counts("conv", "role", THREE), _expected(THREE))
    + f"SELECT cluster, grp, observed, {r6('expected')} AS expected, {r6('residual')} AS residual FROM residuals",
)
def std_residuals(spark, folder):
    rows = conv(spark, folder)
    grid = compare.expected(compare.cells(rows, "role", THREE), THREE)
    return rounded(grid, "expected", "residual")


@query(
    "chi_square",
    _with(CONV, _counts("conv", "role", THREE), _expected(THREE), _chi())
    + f"SELECT {r6('chi2')} AS chi2, {r6('p_value')} AS p_value, CAST(dof AS BIGINT) AS dof FROM answer",
)
def chi_square(spark, folder):
    rows = conv(spark, folder)
    return rounded(
        compare.chi_square(compare.expected(compare.cells(rows, "role", THREE), THREE)), "chi2", "p_value"
    )


QUALITY = ["0", "1"]


@query(
    "chi_square_yates",
    _with(
        META,
        "halves AS (SELECT CASE WHEN cluster >= 5 THEN 1 ELSE 0 END AS cluster, quality FROM meta)",
        _counts("halves", "quality", QUALITY),
        _expected(QUALITY),
        _chi(),
    )
    + f"SELECT {r6('chi2')} AS chi2, {r6('p_value')} AS p_value, CAST(dof AS BIGINT) AS dof FROM answer",
)
def chi_square_yates(spark, folder):
    """Two clusters by two groups: the corrected statistic."""
    halves = meta(spark, folder).withColumn("cluster", F.when(F.col("cluster") >= 5, 1).otherwise(0))
    grid = compare.expected(compare.cells(halves, "quality", QUALITY), QUALITY)
    return rounded(compare.chi_square(grid), "chi2", "p_value")


@query(
    "chi_square_many_groups",
    _with(META, _counts("meta", "source"), _expected(), _chi())
    + f"SELECT {r6('chi2')} AS chi2, {r6('p_value')} AS p_value, CAST(dof AS BIGINT) AS dof FROM answer",
)
def chi_square_many_groups(spark, folder):
    """Noise row kept, every source a group: many degrees of freedom."""
    rows = meta(spark, folder)
    names = _all_groups(rows, "source")
    return rounded(
        compare.chi_square(compare.expected(compare.cells(rows, "source", names), names)), "chi2", "p_value"
    )


@query(
    "residual_topk",
    _with(CONV, CONV_CLUSTERS, _counts("conv", "role", THREE), _expected(THREE))
    + f"""SELECT r.cluster, COALESCE(c.label, 'Cluster_ID ' || CAST(r.cluster AS VARCHAR)) AS label, r.grp,
       {r6('r.residual')} AS residual, CASE WHEN r.residual > 0 THEN 'over' ELSE 'under' END AS direction
FROM (SELECT * FROM residuals ORDER BY abs(residual) DESC, cluster, grp LIMIT 10) r
LEFT JOIN clusters c ON c.cluster = r.cluster""",
)
def residual_topk(spark, folder):
    rows, clusters, counts, _ = _three(spark, folder)
    return rounded(charts.largest_residuals(compare.expected(counts, THREE), clusters), "residual")


@query(
    "residual_labels",
    _with(META, META_CLUSTERS, _counts("meta", "quality", QUALITY), _expected(QUALITY))
    + f"""SELECT r.cluster, r.grp, {r6('r.residual')} AS residual,
       COALESCE(c.label, 'Cluster_ID ' || CAST(r.cluster AS VARCHAR)) AS label
FROM residuals r LEFT JOIN clusters c ON c.cluster = r.cluster""",
)
def residual_labels(spark, folder):
    rows = meta(spark, folder)
    grid = compare.expected(compare.cells(rows, "quality", QUALITY), QUALITY)
    labelled = charts.with_labels(grid, conv_clusters(rows))
    return rounded(labelled.select("cluster", "grp", "residual", "label"), "residual")


@query(
    "significant_topk",
    _with(*TWO_WIDE, _tested(TWO))
    + f"""SELECT "Cluster_ID", "Cluster_Label",
       CASE WHEN "Difference" > 0 THEN 'more in user' ELSE 'more in assistant' END AS direction, {TESTS.replace(
           r6('"Z_Score"') + ' AS "Z_Score", ', '')}
FROM tests WHERE "P_Value" < 0.05 ORDER BY abs("Difference") DESC, "Cluster_ID" LIMIT 10""",
)
def significant_topk(spark, folder):
    top = charts.significant(_tested_two(spark, folder), TWO)
    return rounded(top, "Difference", "P_Value", "CI_Lower", "CI_Upper")


@query(
    "difference_chart",
    _with(*TWO_WIDE, _tested(TWO))
    + f"""SELECT "Cluster_ID", "Cluster_Label", {r6('"Difference"')} AS "Difference"
FROM tests WHERE "P_Value" < 0.05 ORDER BY abs("Difference") DESC, "Cluster_ID" LIMIT 15""",
)
def difference_chart(spark, folder):
    top = charts.significant(_tested_two(spark, folder), TWO, 15)
    return rounded(top.select("Cluster_ID", "Cluster_Label", "Difference"), "Difference")


@query(
    "top5_per_group",
    _with(*TWO_WIDE, _tested(TWO))
    + f"""SELECT s.grp, CAST(s.grp_ord AS BIGINT) AS grp_ord, s.place, s.cluster, s.label, {r6('s.pct')} AS pct,
       {r6('t."P_Value"')} AS p_value
FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pct DESC, cluster) AS place FROM shares) s
JOIN tests t ON t."Cluster_ID" = s.cluster WHERE s.place <= 5""",
)
def top5_per_group(spark, folder):
    _, clusters, counts, totals = _two(spark, folder)
    tests = compare.z_tests(compare.proportions(counts, clusters, totals), totals)
    top = charts.top_per_group(compare.shares(counts, clusters, totals), tests)
    return rounded(top.withColumns({c: F.col(c).cast("bigint") for c in ("grp_ord", "place")}), "pct", "p_value")


@query(
    "cluster_rows_left_join",
    _with(META, "clusters AS (SELECT DISTINCT label AS cluster FROM embeddings)", _counts("meta", "lang"))
    + """SELECT c.cluster, CAST(COALESCE(sum(k.n), 0) AS BIGINT) AS n_rows
FROM clusters c LEFT JOIN counts k ON k.cluster = c.cluster GROUP BY c.cluster""",
)
def cluster_rows_left_join(spark, folder):
    """Every known cluster, also those no document row belongs to."""
    known = table(spark, folder, "embeddings").select(F.col("label").alias("cluster")).distinct()
    totals = compare.cluster_totals(_all_cells(meta(spark, folder), "lang"))
    return known.join(totals, "cluster", "left").select(
        "cluster", F.coalesce("n_cluster", F.lit(0)).alias("n_rows")
    )


SUMMARY = [
    META,
    """summary AS (SELECT cluster AS "Cluster_ID", 'Cluster ' || CAST(cluster + 1 AS VARCHAR) AS "Cluster_Label",
       count(*) AS "Message_Count" FROM meta WHERE cluster >= 0 GROUP BY cluster)""",
]


def _sizes(rows):
    """Cluster sizes in the shape of a summary."""
    return (
        rows.where(F.col("cluster") >= 0)
        .groupBy(F.col("cluster").alias("Cluster_ID"))
        .agg(F.count(F.lit(1)).alias("Message_Count"))
        .withColumn(
            "Cluster_Label", F.concat(F.lit("Cluster "), (F.col("Cluster_ID") + 1).cast("string"))
        )
    )


def _all_groups(rows, column):
    return [r["grp"] for r in group_values(rows, column).collect()]  # one short line per group


def _finer(spark, folder):
    """Documents clustered by vector label and language: enough clusters for a tail."""
    rows = meta(spark, folder).where(F.col("cluster") >= 0)
    languages = rows.select("lang").distinct().withColumn("code", F.row_number().over(W.orderBy("lang")))
    coded = rows.join(languages, "lang")
    return coded.withColumn("cluster", (F.col("cluster") * 1000 + F.col("code")).cast("int")).drop("code")


FINER = """labelled AS (SELECT d.doc_id AS row_id, d.lang, d.source, e.label
  FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id),
codes AS (SELECT lang, row_number() OVER (ORDER BY lang) AS code FROM (SELECT DISTINCT lang FROM labelled)),
meta0 AS (SELECT row_id, lang, source, CAST(label * 1000 + code AS INTEGER) AS cluster FROM labelled JOIN codes USING (lang))"""
FINER_SUMMARY = """summary AS (SELECT cluster AS "Cluster_ID", 'Cluster ' || CAST(cluster + 1 AS VARCHAR) AS "Cluster_Label",
       count(*) AS "Message_Count" FROM meta0 GROUP BY cluster)"""


@query(
    "sizes_top25",
    _with(FINER, FINER_SUMMARY)
    + 'SELECT "Cluster_ID", "Cluster_Label", "Message_Count" FROM summary ORDER BY "Message_Count" DESC, "Cluster_ID" LIMIT 25',
)
def sizes_top25(spark, folder):
    return charts.sizes(_sizes(_finer(spark, folder)))


@query(
    "pie_top_other",
    _with(
        FINER,
        FINER_SUMMARY,
        """ranked AS (SELECT row_number() OVER (ORDER BY "Message_Count" DESC, "Cluster_ID") AS place,
       "Cluster_Label" AS label, "Message_Count" AS n FROM summary)""",
    )
    + """SELECT place, label, CAST(n AS BIGINT) AS n FROM ranked WHERE place <= 10
UNION ALL SELECT 11, 'Other', CAST(sum(n) AS BIGINT) FROM ranked WHERE place > 10 HAVING sum(n) > 0""",
)
def pie_top_other(spark, folder):
    rows = _finer(spark, folder)
    out = charts.pie(_sizes(rows), rows.count())
    return out.withColumn("place", F.col("place").cast("bigint"))


@query(
    "overview_shares",
    _with(*SUMMARY)
    + f"""SELECT "Cluster_ID", "Cluster_Label", "Message_Count",
       {r6('100.0 * "Message_Count" / (SELECT sum("Message_Count") FROM summary)')} AS pct FROM summary""",
)
def overview_shares(spark, folder):
    rows = meta(spark, folder)
    total = rows.where(F.col("cluster") >= 0).count()
    return rounded(charts.overview_shares(_sizes(rows), total), "pct")


@query(
    "summary_sorted",
    _with(*SUMMARY)
    + """SELECT "Cluster_ID", "Message_Count", row_number() OVER (ORDER BY "Message_Count" DESC, "Cluster_ID") AS place
FROM summary ORDER BY place""",
)
def summary_sorted(spark, folder):
    ordered = by_size(_sizes(meta(spark, folder))).withColumn("_seq", F.monotonically_increasing_id())
    return ordered.select("Cluster_ID", "Message_Count", _place().alias("place"))


FINER_SHARES = [FINER, CLUSTERS.format(rows="meta0"), _counts("meta0", "lang"), _grid()]


def _finer_shares(spark, folder):
    rows = _finer(spark, folder)
    groups = _all_groups(rows, "lang")
    counts = cut_lineage(compare.cells(rows, "lang", groups))
    return compare.shares(counts, conv_clusters(rows), compare.totals_of(counts, groups))


LARGEST = """sized AS (SELECT cluster, label, sum(n) AS n_cluster FROM shares GROUP BY cluster, label),
ranks AS (SELECT *, row_number() OVER (ORDER BY n_cluster DESC, cluster) AS place FROM sized)"""


@query(
    "mix_top_other",
    _with(
        *FINER_SHARES, LARGEST,
        "kept AS (SELECT s.grp, s.label, s.pct FROM shares s JOIN ranks r ON r.cluster = s.cluster WHERE r.place <= 10)",
    )
    + f"""SELECT grp, label, {r6('pct')} AS pct FROM kept
UNION ALL SELECT grp, 'Other', {r6('greatest(0.0, 100.0 - sum(pct))')} FROM kept
WHERE (SELECT count(*) FROM sized) > 10 GROUP BY grp""",
)
def mix_top_other(spark, folder):
    return rounded(charts.mix(_finer_shares(spark, folder)), "pct")


@query(
    "dominant_group",
    _with(*FINER_SHARES)
    + f"""SELECT cluster, label, CAST(sum(n) AS BIGINT) AS n_cluster,
       arg_max(grp, (pct, -grp_ord)) AS dominant_group, {r6('max(pct)')} AS dominant_share
FROM shares GROUP BY cluster, label""",
)
def dominant_group(spark, folder):
    return rounded(charts.dominant(_finer_shares(spark, folder)), "dominant_share")


@query(
    "heatmap_table",
    _with(
        CONV, CONV_CLUSTERS, _counts("conv", "role", THREE), _grid(THREE), _wide(THREE),
        'summed AS (SELECT *, "user_Count" + "assistant_Count" + "system_Count" AS "Total_Count" FROM wide)',
    )
    + f'SELECT "Cluster_ID", "Cluster_Label", "Total_Count", {PERCENTS3} FROM summed '
    + 'ORDER BY "Total_Count" DESC, "Cluster_ID" LIMIT 20',
)
def heatmap_table(spark, folder):
    _, clusters, counts, totals = _three(spark, folder)
    out = charts.heatmap(compare.proportions(counts, clusters, totals), THREE)
    return rounded(out, *[f"{g}_Percent" for g in THREE])


@query(
    "facet_topk",
    _with(META, META_CLUSTERS, _counts("meta", "source"), _grid())
    + f"""SELECT s.grp, s.place, s.cluster, s.label, {r6('s.pct')} AS pct
FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pct DESC, cluster) AS place FROM shares) s
WHERE s.place <= 12 AND s.grp IN (SELECT grp FROM shares GROUP BY grp, grp_ord ORDER BY sum(n) DESC, grp_ord LIMIT 5)""",
)
def facet_topk(spark, folder):
    rows = meta(spark, folder)
    groups = _all_groups(rows, "source")
    counts = cut_lineage(compare.cells(rows, "source", groups))
    share = compare.shares(counts, conv_clusters(rows), compare.totals_of(counts, groups))
    return rounded(charts.facets(share).withColumn("place", F.col("place").cast("bigint")), "pct")


@query(
    "sankey_edges",
    _with(*FINER_SHARES, LARGEST)
    + """SELECT r.place - 1 AS source, s.grp_ord + least(20, (SELECT count(*) FROM sized)) AS target, s.n AS value
FROM shares s JOIN ranks r ON r.cluster = s.cluster WHERE r.place <= 20 AND s.n > 0""",
)
def sankey_edges(spark, folder):
    return charts.edges(_finer_shares(spark, folder))


@query(
    "compare_step",
    _with(*TWO_WIDE, _tested(TWO))
    + f"""SELECT "Cluster_Label", "Cluster_ID", "user_Count", "assistant_Count", {PERCENTS2}, {TESTS} FROM tests""",
)
def compare_all(spark, folder):
    """The flagship: which clusters differ between two groups."""
    rows = conv(spark, folder)
    done = compare_step(rows, conv_clusters(rows), "role", TWO)
    return rounded(done.table, "user_Percent", "assistant_Percent", *TEST_NAMES)
