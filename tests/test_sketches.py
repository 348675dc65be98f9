"""Bounded summaries that give exact results: top words, column tests, picks."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from themescope.operators import keywords as kw
from themescope.operators import summary
from themescope.operators.profile import first_kinds, mostly_text_columns
from themescope.operators.rows import seeded_hash
from themescope.plans.steps import cluster_step

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def drawn_texts(seed, n):
    """Texts whose words follow no order: a few frequent ones among hundreds that stand once or twice."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices(LETTERS, k=5)) for _ in range(400)]
    rows = []
    for i in range(n):
        text = [vocabulary[min(399, int(draw.expovariate(0.02)))] for _ in range(draw.randint(0, 12))]
        rows.append((i, draw.choice([0, 0, 0, 1, 2, None]), " ".join(text)))
    return rows


@pytest.mark.parametrize("counters", [10, 60, 20_000])
def test_top_words_are_exact_with_few_counters(spark, counters):
    rows = drawn_texts(3, 600)
    df = spark.createDataFrame(rows, "row_id bigint, cluster int, text string").repartition(7)
    got = kw.top_keywords(df, n=4, stopwords=["zzzzz"], counters=counters).collect()
    frequent = kw.word_freq(df, "cluster", n=6, stopwords=[], counters=counters).collect()
    for cluster in (0, 1, 2, None):
        counts, first = collections.Counter(), {}
        for i, c, text in rows:
            if c == cluster:
                for place, word in enumerate(text.split()):
                    counts[word] += 1
                    first.setdefault(word, (i, place))
        want = sorted(counts, key=lambda w: (-counts[w], first[w]))[:4]
        assert [(r["word"], r["n"]) for r in sorted(got, key=lambda r: r["rank"]) if r["cluster"] == cluster] == [(w, counts[w]) for w in want]
        want = sorted(counts, key=lambda w: (-counts[w], w))[:6]
        assert [(r["word"], r["n"]) for r in sorted(frequent, key=lambda r: r["rank"]) if r["grp"] == cluster] == [(w, counts[w]) for w in want]


def test_no_words_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "a b"), (2, 0, None)], "row_id bigint, cluster int, text string")
    assert kw.top_keywords(df).count() == 0 and kw.top_keywords(df.where("false")).count() == 0


def test_column_test_scans_once(spark, tmp_path):
    rows = [(i, str(i) if i % 3 else f"w{i}", None if i < 900 else "x", "7" if i % 2 else None) for i in range(1000)]
    spark.createDataFrame(rows, "row_id bigint, a string, b string, c string").repartition(6).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = {r["column"]: (r["n_sampled"], r["n_text"], r["is_text"]) for r in mostly_text_columns(df, "row_id", sample_rows=50).collect()}
    assert got == {"a": (50, 17, False), "b": (50, 50, True), "c": (50, 0, False)}
    plan = first_kinds(df, "row_id", ["a", "b", "c"], 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def picked_plainly(rows, n, seed_of):
    out = {}
    for cluster in {r[0] for r in rows}:
        mine = sorted((r[1], r[2]) for r in rows if r[0] == cluster)
        fits = [i for i, t in mine if 20 <= len(t) <= 200]
        pool = [i for i, _ in mine] if len(mine) <= n or len(fits) < n else fits
        if len(mine) <= n:
            out[cluster] = pool
            continue
        fixed = [pool[0]] + ([pool[len(pool) // 2]] if len(pool) > 2 else []) + ([pool[-1]] if len(pool) > 1 else [])
        rest = sorted((i for i in pool if i not in fixed), key=lambda i: seed_of[i])
        out[cluster] = (fixed + rest)[:n]
    return out


def test_picks_from_one_pass_equal_plain_picks(spark, monkeypatch):
    draw = random.Random(4)
    rows = []
    for k, (cluster, many, low, high) in enumerate([(0, 500, 1, 300), (1, 8, 1, 300), (2, 9, 1, 10), (3, 40, 19, 22), (4, 1, 5, 5)]):
        rows += [(cluster, draw.randint(0, 10**6) * 8 + k, "t" * draw.randint(low, high)) for _ in range(many)]
    rows = list({r[1]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "cluster int, row_id bigint, text string").repartition(5)
    hashes = {r["row_id"]: r["h"] for r in df.select("row_id", seeded_hash(F.col("row_id"), 42).alias("h")).collect()}
    want = picked_plainly(rows, 8, hashes)
    for lines in (200_000, 10):
        monkeypatch.setattr(summary, "_SKETCH_LINES", lines)
        got = collections.defaultdict(list)
        for r in summary.representatives(df).orderBy("cluster", "place").collect():
            got[r["cluster"]].append(r["row_id"])
        assert dict(got) == want


def test_words_are_taken_from_few_texts_at_once(monkeypatch):
    import pyarrow as pa

    lists = [["a"] * 40, None, [], ["b"] * 300, ["c"] * 30, ["d"] * 90, []]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 7), pa.array(range(7)), pa.array(lists)], names=["by", "row_id", "words"])
    monkeypatch.setattr(kw, "_WORDS", 100)
    parts = list(kw._parts(batch))
    assert [i for p in parts for i in p.column(1).to_pylist()] == list(range(7))
    # the words of a part, its last text left out
    assert all(sum(len(x or []) for x in p.column(2).to_pylist()[:-1]) <= 100 for p in parts) and len(parts) == 3
    assert list(kw._parts(batch.slice(0, 0))) == []


def counted_texts(spark, rows, schema):
    """Rows whose texts are counted as they are read."""
    read = spark.sparkContext.accumulator(0)

    def count(text):
        read.add(1)
        return text

    return spark.createDataFrame(rows, schema).withColumn("text", F.udf(count)("text")), read


def test_a_summary_reads_texts_once(spark):
    rows = [(i, i % 3 - 1, f"late parcel number {i}", "ab"[i % 2]) for i in range(60)]
    df, read = counted_texts(spark, rows, "row_id bigint, cluster int, text string, kind string")
    out = summary.cluster_summary(df, category_columns="auto").orderBy("Cluster_ID").collect()
    assert [(r["Message_Count"], r["kind__a_Count"], r["kind__b_Count"]) for r in out] == [(20, 10, 10), (20, 10, 10)]
    assert read.value <= 60


def test_a_clustering_reads_texts_once(spark):
    rows = [(i, f"late parcel {i}", [float(i % 2 * 50), float(i % 5), 1.0]) for i in range(40)]
    df, read = counted_texts(spark, rows, "row_id bigint, text string, embedding array<double>")
    done = cluster_step(df, "kmeans", k=2, components=2)
    assert sorted(r["Message_Count"] for r in done.summary.collect()) == [20, 20] and done.rows.count() == 40
    assert read.value <= 40
