"""Hand-made inputs for the corners of each operator."""

import math

import pytest
from pyspark.sql import functions as F

from themescope.functions import stats, text
from themescope.operators import charts, compare, profile, summary
from themescope.operators.embed import embed_text
from themescope.operators.keywords import keyword_lists, top_keywords
from themescope.operators.rows import hash_sample, join_repeated, nth_key, rank_in_group, slice_rows
from themescope.plans import report
from themescope.plans.steps import cluster_step, compare_step, embed_step
from themescope.sources import lexicon, tables, text_csv


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- text ---------------------------------------------------------------


def test_blank_texts_are_dropped(spark):
    rows = [(i, t) for i, t in enumerate(["", "  ", "\t", " ", "　 ", None, "　 a b ", "\x1cz"])]
    df = frame(spark, rows, "row_id bigint, t string")
    kept = df.where(~text.is_blank(F.col("t"))).select(text.strip(F.col("t")).alias("t"))
    assert [r["t"] for r in kept.collect()] == ["a b", "z"]


def test_numbers_follow_scripting_rules(spark):
    cases = {
        "1": True, "1e5": True, " 12 ": True, "nan": True, "inf": True, "-Infinity": True, "1_000": True,
        "1d": False, "1.5f": False, "-3.": True, "abc": False, "0x1p3": False, "1__0": False, ".5": True,
    }
    df = frame(spark, [(k,) for k in cases], "t string")
    got = {r["t"]: r["ok"] for r in df.select("t", text.parses_as_float(F.col("t")).alias("ok")).collect()}
    assert got == cases


def test_words_next_to_accents_and_digits(spark):
    got = one(spark, text.words(F.lit("café abc don't naïve foo_bar hello2 ABC abcd")))
    assert got == ["abc", "don", "abc", "abcd"]


def test_sentiment_order_and_substrings(spark):
    cases = {"all good": 1, "not good": -1, "breakfast": 1, "BAD day": -1, "plain": 0, "good": 0}
    for words, want in cases.items():
        assert one(spark, text.sentiment(F.lit(words))) == want
    assert one(spark, text.sentiment(F.lit(None).cast("string"))) == 0
    assert one(spark, text.sentiment(F.lit("IT is"), ["IT"], [])) == -1


def test_label_cleanup(spark):
    assert one(spark, text.clean_label(F.lit(' "Late  \'parcel\' again today now" '))) == "Late parcel again today"


def test_keyword_ties_keep_first_seen(spark):
    rows = [(0, 1, "zebra apple"), (0, 2, "apple zebra mango"), (0, 3, "the with mango"), (1, 4, "it is")]
    msgs = frame(spark, rows, "cluster int, row_id bigint, text string")
    lists = {r["cluster"]: r["keywords"] for r in keyword_lists(top_keywords(msgs)).collect()}
    assert lists == {0: ["zebra", "apple", "mango"]}


# --- rows ---------------------------------------------------------------


def test_slices(spark):
    ids = [3, 5, 8, 1000, 5000, 70000, 70001, 9000000]
    df = frame(spark, [(i,) for i in ids], "row_id bigint")
    assert [nth_key(df, "row_id", n) for n in range(1, 10)] == [*ids, None]

    def got(**kw):
        return sorted(r["row_id"] for r in slice_rows(df, "row_id", **kw).collect())

    assert got() == ids and got(limit=0) == ids
    assert got(skip=2, limit=3) == ids[2:5]
    assert got(skip=6, limit=10) == ids[6:]
    assert got(skip=9) == []


def test_rank_and_sample(spark):
    df = spark.range(0, 500, 3).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("g"))
    ranks = rank_in_group(df, ["g"], "row_id", "k", width=16).collect()
    for g in (0, 1):
        ordered = sorted((r["row_id"], r["k"]) for r in ranks if r["g"] == g)
        assert [k for _, k in ordered] == list(range(len(ordered)))
    a = {r["row_id"] for r in hash_sample(df, "row_id", 20).collect()}
    assert len(a) == 20 and a == {r["row_id"] for r in hash_sample(df.repartition(5), "row_id", 20).collect()}
    assert hash_sample(df, "row_id", 1000).count() == df.count()


def test_hot_key_is_cut_into_pieces(spark):
    left = spark.range(300).select(F.col("id").alias("row_id"), F.when(F.col("id") < 200, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    right = left.groupBy("key").agg(F.min("row_id").alias("v"))
    out = join_repeated(left, right, "key", spread=30)
    assert out.columns == ["key", "row_id", "v"]
    assert out.count() == 300 and out.where("key = 'hot' and v = 0").count() == 200


# --- embedding ----------------------------------------------------------


def test_failing_embedder_gives_zero_vectors(spark):
    def embedder(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    rows = frame(spark, [(0, "ab"), (1, "boom"), (2, "ab"), (3, "abc")], "row_id bigint, text string")
    out = embed_text(rows, embedder, calls=2)
    metrics = report.JobMetrics(out)
    got = {r["row_id"]: (r["embedding"], r["failed"]) for r in metrics.df.collect()}
    assert got == {0: ([2.0, 1.0], False), 1: ([0.0, 0.0], True), 2: ([2.0, 1.0], False), 3: ([3.0, 1.0], False)}
    seen = metrics.result()
    assert seen["rows"] == 4 and seen["failed"] == 1 and seen["rate"] > 0


def test_second_embedder_and_unknown_width(spark):
    def never(texts):
        raise RuntimeError("down")

    rows = frame(spark, [(0, "ab")], "row_id bigint, text string")
    got = embed_text(rows, never, second=lambda ts: [[7.0] for _ in ts]).first()
    assert got["embedding"] == [7.0] and not got["failed"]
    lost = embed_text(rows, never).first()
    assert len(lost["embedding"]) == 3072 and lost["failed"]


def test_embed_step_projects_text(spark):
    rows = frame(spark, [(0, " a cat ", "x"), (1, "  ", "y"), (2, "dogs", "z")], "row_id bigint, body string, text string")
    got = embed_step(rows, "body", limit=1).collect()
    assert [(r["row_id"], r["text"], r["body"]) for r in got] == [(0, "a cat", " a cat ")]


# --- profiling ----------------------------------------------------------


def test_text_column_choice(spark):
    df = frame(spark, [(1, "a", "2"), (2, "b", "3")], "row_id bigint, t string, n string")
    assert profile.detect_text_column(df) == "t"
    assert profile.detect_text_column(df.select("row_id", "n")) == "n"
    with pytest.raises(ValueError):
        profile.detect_text_column(df.withColumn("u", F.lit("x")))
    with pytest.raises(ValueError):
        profile.detect_text_column(df.select("n", F.lit("4").alias("m")))
    assert profile.text_column_name(df.withColumnRenamed("t", "Message")) == "Message"
    assert profile.text_column_name(df) is None


def test_group_choice(spark):
    rows = [("a ", str(i), "same") for i in range(60)] + [("b", "60", "same"), ("", "61", "same"), (None, "62", None)]
    df = frame(spark, rows, "g string, many string, single string")
    assert profile.choose_group_column(df) == "g"
    assert profile.choose_group_column(df, "many") == "many"
    with pytest.raises(ValueError):
        profile.choose_group_column(df, "none")
    with pytest.raises(ValueError):
        profile.choose_group_column(df.withColumn("h", F.col("g")))
    assert profile.select_groups(df, "g", ["b, a", "a"]) == ["b", "a"]
    with pytest.raises(ValueError):
        profile.select_groups(df, "g", ["a", "zz"])
    with pytest.raises(ValueError):
        profile.select_groups(df, "g", ["a"])
    assert profile.compare_columns_quick(df) == ["g", "single"]


# --- labels and summaries -----------------------------------------------


def test_label_clashes(spark):
    rows = [(0, "Late"), (1, "late"), (2, "LATE"), (3, "x (1)"), (4, "x"), (5, "X"), (6, "x")]
    out = summary.dedup_labels(frame(spark, rows, "cluster int, label string"))
    got = [r["label"] for r in out.orderBy("cluster").collect()]
    assert got == ["Late", "late (1)", "LATE (2)", "x (1)", "x", "X (2)", "x (3)"]


def test_summary_with_labeller_and_categories(spark):
    rows = [(i, 0, f"parcel late again {i}", "a b") for i in range(12)] + [(20, 1, "hello", "c"), (21, -1, "noise", "d"), (22, 1, " ", None)]
    df = frame(spark, rows, "row_id bigint, cluster int, text string, `my col` string")
    out = summary.cluster_summary(df, lambda prompts: ['"Late   parcels" and more words' for _ in prompts], ["my col"])
    got = {r["Cluster_ID"]: r for r in out.collect()}
    assert got[0]["Cluster_Label"] == "Late parcels and more" and got[0]["my_col__a_b_Count"] == 12
    assert got[0]["my_col__d_Count"] == 0 and got[1]["my_col__c_Count"] == 1
    assert got[1]["Cluster_Label"] == "Cluster 2" and got[1]["Top_Keywords"] == "" and got[1]["Message_Count"] == 1
    assert got[0]["Top_Keywords"].split(", ") == ["parcel", "late", "again"]
    assert len(got[0]["Sample_Messages"].split(" | ")) == 5

    def broken(prompts):
        raise RuntimeError("no service")

    plain = {r["Cluster_ID"]: r["Cluster_Label"] for r in summary.cluster_summary(df, broken).collect()}
    assert plain == {0: "Parcel / Late / Again", 1: "Cluster 2"}


def test_all_noise_gives_empty_summary(spark):
    df = frame(spark, [(0, -1, "abc def")], "row_id bigint, cluster int, text string")
    out = summary.cluster_summary(df)
    assert out.count() == 0 and out.columns[:2] == ["Cluster_ID", "Cluster_Label"]


def test_cluster_step_end_to_end(spark):
    words = {0: "parcel late slow box", 1: "refund money card bank", 2: "login password screen error"}
    rows = [(i, words[i % 3] + f" {'good'} number", "ab"[i % 2]) for i in range(60)]
    df = embed_text(frame(spark, rows, "row_id bigint, text string, grp string"))
    for algorithm in ("kmeans", "agglomerative"):
        done = cluster_step(df, algorithm, k=3, components=10)
        assert [c for c in done.summary.columns if c.endswith("_Count")][1:] == ["grp__a_Count", "grp__b_Count"]
        assert sorted(r["Message_Count"] for r in done.summary.collect()) == [20, 20, 20]
        assert done.explained is not None
    with pytest.raises(ValueError):
        cluster_step(df, "other")


# --- comparison ---------------------------------------------------------


def test_two_by_two_uses_correction(spark):
    counts = frame(spark, [(0, "a", 10), (0, "b", 20), (1, "a", 30), (1, "b", 15)], "cluster int, grp string, n bigint")
    row = compare.chi_square(compare.expected(counts, ["a", "b"])).first()
    assert row["chi2"] == pytest.approx(6.7522, abs=1e-3) and row["dof"] == 1
    assert row["p_value"] == pytest.approx(math.erfc(math.sqrt(row["chi2"] / 2)))
    single = compare.chi_square(compare.expected(counts.where("cluster = 0"), ["a", "b"])).first()
    assert (single["chi2"], single["p_value"], single["dof"]) == (0.0, 1.0, 0)


def test_chi_square_tail(spark):
    def tail(x, dof):
        return one(spark, stats.chi_square_p(F.lit(x), F.lit(dof)))

    assert tail(9.0, 2) == pytest.approx(math.exp(-4.5))
    assert tail(5.0, 1) == pytest.approx(math.erfc(math.sqrt(2.5)))
    assert tail(7.0, 3) == pytest.approx(math.erfc(math.sqrt(3.5)) + math.sqrt(14 / math.pi) * math.exp(-3.5))
    assert tail(900.0, 1000) == pytest.approx(0.98935, abs=1e-3)
    # far tails keep their digits, and large degrees of freedom cost no more
    assert tail(100.0, 1) == pytest.approx(math.erfc(math.sqrt(50)), rel=1e-9)
    assert tail(1600.0, 1000) == pytest.approx(7.9e-31, rel=0.5)
    for dof in (4_999, 5_001, 1_000_000, 10_000_000_000):
        assert tail(float(dof), dof) == pytest.approx(0.5 - 1 / (3 * math.sqrt(math.pi * dof)), abs=1e-5)
        above = dof + 2 * math.sqrt(2 * dof)  # two standard deviations
        assert tail(above, dof) == pytest.approx(0.02275, abs=0.003)


def test_many_groups_stay_one_expression(spark):
    groups = [f"g{i}" for i in range(2000)]
    counts = spark.range(6000).selectExpr("cast(id % 3 as int) AS cluster", "concat('g', id div 3) AS grp", "id % 7 + 1 AS n")
    grid = compare.expected(counts, groups)
    row = compare.chi_square(grid).first()
    assert row["dof"] == 2 * 1999 and 0 <= row["p_value"] <= 1
    clusters = frame(spark, [(0, "a"), (1, "b"), (2, "c")], "cluster int, label string")
    assert compare.shares(counts, clusters, compare.totals_of(counts, groups)).count() == 6000


def test_labeller_falls_back_prompt_by_prompt(spark):
    prompts = frame(spark, [(0, "- fine"), (1, "- bad"), (2, "- worse")], "cluster int, prompt_lines string")

    def first(asked):
        if any("bad" in q or "worse" in q for q in asked):
            raise RuntimeError("no")
        return ["First"] * len(asked)

    def second(asked):
        if any("worse" in q for q in asked):
            raise RuntimeError("no")
        return ["Second"] * len(asked)

    got = {r["cluster"]: r["model_label"] for r in summary.model_labels(prompts, first, second).collect()}
    assert got == {0: "First", 1: "Second", 2: None}


def test_append_table_reports_a_missing_key(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append_table(frame(spark, [(1,)], "a int"), path, "a")
    with pytest.raises(Exception, match="b"):
        tables.append_table(frame(spark, [(1,)], "b int"), path, "b")
    assert tables.load_chosen_k(spark, str(tmp_path / "none")) is None


def test_zero_error_gives_nulls(spark):
    counts = frame(spark, [(0, "a", 10), (0, "b", 20)], "cluster int, grp string, n bigint")
    clusters = frame(spark, [(0, "all"), (1, "none")], "cluster int, label string")
    totals = compare.totals_of(counts, ["a", "b"])
    got = compare.z_tests(compare.proportions(counts, clusters, totals), totals).collect()
    assert all(r["Z_Score"] is None and r["P_Value"] is None and r["CI_Lower"] is None for r in got)
    empty = compare.z_tests(compare.proportions(counts, clusters, {"a": 10, "zz": 0}), {"a": 10, "zz": 0}).collect()
    assert all(r["Z_Score"] is None for r in empty) and {r["zz_Percent"] for r in empty} == {0.0}
    none = compare.proportions(counts, clusters.where("cluster > 5"), totals)
    assert none.count() == 0 and none.columns[-1] == "Difference"
    with pytest.raises(ValueError):
        compare.totals_of(counts, ["q", "r"])


def comparison(spark, third=False):
    rows, at = [], 0
    for cluster, a, b, c in ((0, 30, 5, 9), (1, 10, 25, 9), (2, 20, 21, 9), (-1, 3, 2, 1)):
        for g, n in (("a", a), ("b", b), ("c", c)):
            if g == "c" and not third:
                continue
            for _ in range(n):
                rows.append((at, cluster, f"parcel number {at}", g))
                at += 1
    df = frame(spark, rows, "row_id bigint, cluster int, text string, grp string")
    out = summary.cluster_summary(df)
    clusters = out.select(F.col("Cluster_ID").alias("cluster"), F.col("Cluster_Label").alias("label"))
    return df, out, compare_step(df, clusters, "grp")


def lines(df):
    order = [c for c in df.columns if c != "line"]
    return [r["line"] for r in df.orderBy(*order).collect()]


def test_comparison_report(spark):
    _, _, done = comparison(spark)
    got = lines(report.comparison_lines(done))
    assert got[1] == "HOW CLUSTERS DIFFER BY 'grp'" and "  a: 63" in got
    assert "Largest in b:" in got and got[-1] == "=" * 60
    top = got[got.index("Largest in a:") + 1]
    assert top.startswith("  Parcel / Number: 47.62% (p=0.0000)")
    found = got[got.index("CLUSTERS WITH DIFFERENT SHARES (p below 0.05)") + 1 :]
    assert "more in b" in found[0] + found[1] and "more in a" in found[0] + found[1]
    _, _, three = comparison(spark, True)
    got = lines(report.comparison_lines(three))
    assert any(line.startswith("  With more than two groups") for line in got)
    cells = got[got.index("CELLS FURTHEST FROM INDEPENDENCE") + 1 :]
    assert "its expected count)" in cells[0] and len(cells) == 10 + 2


def test_overview_report_and_outputs(spark, tmp_path):
    df, out, done = comparison(spark)
    got = lines(report.overview_lines(out, 111, "grp", {"a": 60, "b": 51}, (1.5, 0.25), "2020-01-01 00:00:00"))
    assert got[3:6] == ["Written: 2020-01-01 00:00:00", "Rows with a cluster: 111", "Clusters: 3"]
    assert "  a: 60 (54.1%)" in got and "  p = 0.250000" in got
    first = got.index("Largest cluster first") + 2
    assert got[first + 1] == "    Rows: 41 (36.9%)" and got[first + 2] == "    Words: parcel, number"
    assert got[first + 3] == "" and got[-1] == "=" * 60

    def broken():
        raise RuntimeError("no chart")

    status = {r["name"]: r for r in report.run_outputs(done, out, df, str(tmp_path), {"broken": broken}).collect()}
    assert not status["broken"]["ok"] and "no chart" in status["broken"]["error"]
    assert all(r["ok"] for n, r in status.items() if n != "broken")
    written = [r["value"] for r in spark.read.text(f"{tmp_path}/comparison_report").collect()]
    assert written[1] == "HOW CLUSTERS DIFFER BY 'grp'"
    assert spark.read.parquet(f"{tmp_path}/cluster_sankey").count() > 0


def test_pie_has_no_rest_for_few_clusters(spark):
    sizes = frame(spark, [(i, f"c{i}", 10 - i) for i in range(4)], "Cluster_ID int, Cluster_Label string, Message_Count bigint")
    assert charts.pie(sizes, 100).count() == 4
    assert [r["n"] for r in charts.pie(sizes, 100, 2).orderBy("place").collect()] == [10, 9, 81]


# --- sources and sinks --------------------------------------------------


def test_csv_quirks(spark, tmp_path):
    path = tmp_path / "in.csv"
    body = b'\xef\xbb\xbftext,n\n"two\nlines",1\n"say ""hi""",2\nbad\xff\xfebyte,3\nshort\n"a,b",5\n'
    path.write_bytes(body)
    df = text_csv.read_text_csv(spark, str(path), multi_line=True)
    assert df.columns == ["text", "n", "row_id"]
    got = [(r["row_id"], r["text"], r["n"]) for r in df.orderBy("row_id").collect()]
    assert got == [(0, "two\nlines", "1"), (1, 'say "hi"', "2"), (2, "badbyte", "3"), (3, "short", None), (4, "a,b", "5")]
    assert text_csv.preview(df, 2).count() == 2


def test_row_ids_over_several_files(spark, tmp_path):
    spark.range(0, 1000, 1, 7).select("id").write.parquet(str(tmp_path / "t"))
    df = text_csv.with_row_id(spark.read.parquet(str(tmp_path / "t")))
    got = [r["id"] for r in df.orderBy("row_id").collect()]
    assert got == list(range(1000))
    assert df.agg(F.min("row_id"), F.max("row_id"), F.count_distinct("row_id")).first()[:] == (0, 999, 1000)


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    a = frame(spark, [(1, "x")], "row_id bigint, a string")
    b = frame(spark, [(1, "x", "q"), (2, "y", "r")], "row_id bigint, a string, b string")
    tables.append_table(a, path)
    tables.append_table(b, path, dedup_on="row_id")
    tables.append_table(b, path)
    assert sorted(r["row_id"] for r in tables.read_appended(spark, path).collect()) == [1, 1, 2, 2]
    tables.write_csv(a, str(tmp_path / "c"))
    raw = next((tmp_path / "c").glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfrow_id,a")
    assert tables.load_chosen_k(spark, str(tmp_path / "k")) is None
    tables.save_chosen_k(spark, 7, str(tmp_path / "k"))
    assert tables.load_chosen_k(spark, str(tmp_path / "k")) == 7
    old = frame(spark, [(1, "x")], "Topic_ID int, Topic_Label string")
    assert tables.rename_legacy(old).columns == ["Cluster_ID", "Cluster_Label"]
    assert profile.groups_in_comparison(frame(spark, [(1, 2)], "a_Count int, b int")) == ["a"]


def test_lexicon(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text('{"sentiment_words": {"negative": ["  slow ", ""], "positive": ["nice"]}}')
    got = lexicon.read_lexicon(spark, str(good))
    assert (got.negative, got.positive) == (["slow"], ["nice"])
    for body in ("{", '{"sentiment_words": 3}', '{"other": {}}'):
        path = tmp_path / "bad.json"
        path.write_text(body)
        got = lexicon.read_lexicon(spark, str(path))
        assert (got.negative, got.positive) == (["bad"], ["good"])
    missing = lexicon.read_lexicon(spark, str(tmp_path / "none.json"))
    assert (missing.negative, missing.positive) == (["bad"], ["good"])
    assert one(spark, lexicon.split_words(F.lit(" a, b\n\nc ,, d e\r\n"))) == ["a", "b", "c", "d e"]
