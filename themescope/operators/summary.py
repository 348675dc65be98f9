"""One row per cluster: size, label, keywords, sample texts, category counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from themescope.functions.text import (
    clean_label,
    is_blank,
    prompt_line,
    strip,
    title_label,
)
from themescope.operators.keywords import keyword_lists, top_keywords
from themescope.operators.profile import summary_columns
from themescope.operators.rows import first_in_group, rank_in_group, seeded_hash
from themescope.session import cut_lineage

PICKED = 8
SHORTEST, LONGEST = 20, 200
SAMPLES = 5
NOT_CATEGORIES = ("row_id", "cluster", "Cluster", "text", "Message", "embedding", "failed")


def messages(rows: DataFrame) -> DataFrame:
    """``(cluster, row_id, text)``: trimmed, non-blank texts of rows in a cluster."""
    return (
        rows.where(F.col("cluster") >= 0)
        .select("cluster", "row_id", strip(F.col("text")).alias("text"))
        .where(~is_blank(F.col("text")))
    )


def tallies(rows: DataFrame) -> DataFrame:
    """Number of clusters, noise rows and rows in clusters."""
    inside = F.col("cluster") >= 0
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.when(inside, 1)).alias("n_clusters"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_noise"),
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("n_assigned"),
    )


def sample_messages(msgs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """``(cluster, samples)``: the first n texts in row order, bar-separated.

    Keys are picked first, so no text is sorted; the few lines found are written
    once and fetch their texts by a join planned from that size.
    """
    keys = first_in_group(msgs.select("cluster", "row_id"), ["cluster"], [F.asc("row_id")], n)
    first = cut_lineage(keys).join(msgs, ["cluster", "row_id"])
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return first.groupBy("cluster").agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), " | ").alias("samples")
    )


def representatives(msgs: DataFrame, n: int = PICKED, seed: int = 42) -> DataFrame:
    """``(cluster, place, row_id, text)``: up to n varied texts of each cluster.

    All of a small cluster; otherwise the first, middle and last row (of the
    20..200 character texts when there are enough) and a random fill. Texts are read
    twice: once for their lengths, which are written as keys, and once for the few picked.
    All picks come from one pass over the keys (``key_sketch``), but for the middle, which
    reads its key range again.
    """
    length = F.length("text")
    keys = cut_lineage(msgs.select("cluster", "row_id", length.between(SHORTEST, LONGEST).alias("fits")))
    sketch = cut_lineage(key_sketch(keys, n + 3, seed))
    ranges = sketch.where(F.col("hash").isNull())
    totals = ranges.groupBy("cluster").agg(
        F.sum("n").alias("n_all"), F.sum("n_fit").alias("n_fit"),
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.min("first_fit").alias("first_fit"), F.max("last_fit").alias("last_fit"),
    )
    # the pool: texts that fit, where there are enough, else all
    fitting = (F.col("n_fit") >= n) & (F.col("n_all") > n)
    plan = totals.select(
        "cluster", "n_all", fitting.alias("fitting"),
        F.when(fitting, F.col("n_fit")).otherwise(F.col("n_all")).alias("n_pool"),
        F.when(fitting, F.col("first_fit")).otherwise(F.col("first")).alias("first"),
        F.when(fitting, F.col("last_fit")).otherwise(F.col("last")).alias("last"),
    )
    middle = _middle_rows(keys, ranges, plan)
    fixed = plan.join(middle, "cluster", "left").select(
        "cluster",
        "n_all",
        "fitting",
        F.when(
            F.col("n_all") > n,
            F.array_compact(
                F.array(
                    "first",
                    F.when(F.col("n_pool") > 2, F.col("middle")),
                    F.when(F.col("n_pool") > 1, F.col("last")),
                )
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("fixed"),
    )
    # Small clusters list everything in row order; others add n hashes to choose
    # from after up to three fixed rows.
    draws = sketch.where(F.col("hash").isNotNull()).select("cluster", "row_id", "hash", "of_fitting")
    drawn = (
        draws.join(fixed, "cluster")
        .where((F.col("of_fitting") == F.col("fitting")) & ~F.array_contains("fixed", F.col("row_id")))
        .select("cluster", "row_id", F.when(F.col("n_all") > n, F.col("hash")).otherwise(F.lit("")).alias("_hash"))
        .withColumn("_order", F.lit(10).cast("bigint"))
    )
    listed = fixed.select("cluster", F.posexplode("fixed").alias("_order", "row_id")).select(
        "cluster", "row_id", F.lit("").alias("_hash"), F.col("_order").cast("bigint")
    )
    order = [F.asc("_order"), F.asc("_hash"), F.asc("row_id")]
    picked = first_in_group(drawn.unionByName(listed), ["cluster"], order, n, "place")
    # At most n keys per cluster: written once, so that fetching their texts is
    # planned from the real size.
    found = cut_lineage(picked.select("cluster", "place", "row_id"))
    return found.join(msgs, ["cluster", "row_id"])


_SKETCH = (
    "cluster {0}, key_range bigint, n bigint, n_fit bigint, first bigint, last bigint, first_fit bigint, last_fit bigint, "
    "row_id bigint, hash string, of_fitting boolean"
)
_SKETCH_LINES = 200_000


def key_sketch(keys: DataFrame, draws: int, seed: int = 42, width: int = 1 << 16) -> DataFrame:
    """What picks need to know of ``(cluster, row_id, fits)``, from a single pass.

    Lines without a hash count a key range of a cluster: rows, rows that fit, first and last of
    both. Lines with a hash are the rows of least hash among all rows or among those that fit,
    ``draws`` a task. Lines of several tasks add up: sums, least, greatest, least hashes.
    """
    kind = keys.schema["cluster"].dataType.simpleString()

    def counted(df: pd.DataFrame) -> pd.DataFrame:
        by = df.groupby(["cluster", "key_range"], sort=False)
        return by.agg(
            {"n": "sum", "n_fit": "sum", "first": "min", "last": "max", "first_fit": "min", "last_fit": "max"}
        ).reset_index()

    def least(df: pd.DataFrame) -> pd.DataFrame:
        return df.sort_values("hash").groupby(["cluster", "of_fitting"], sort=False).head(draws)

    def lines(ranges: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        out = pd.concat([ranges, drawn], ignore_index=True)
        whole = ["key_range", "n", "n_fit", "first", "last", "first_fit", "last_fit", "row_id"]
        out[whole] = out[whole].astype("Int64")
        out["of_fitting"] = out["of_fitting"].astype("boolean")
        return out[["cluster", *whole[:-1], "row_id", "hash", "of_fitting"]]

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = pd.DataFrame({c: [] for c in ("cluster", "row_id", "hash", "of_fitting")})
        ranges, drawn = None, empty
        for batch in batches:
            if not len(batch):
                continue
            fit = batch["row_id"].where(batch["fits"])
            new = pd.DataFrame(
                {
                    "cluster": batch["cluster"], "key_range": batch["row_id"] // width, "n": 1,
                    "n_fit": batch["fits"].astype("int64"), "first": batch["row_id"], "last": batch["row_id"],
                    "first_fit": fit.astype("Int64"), "last_fit": fit.astype("Int64"),
                }
            )
            new = counted(new)
            ranges = new if ranges is None else counted(pd.concat([ranges, new]))
            every = least(batch[["cluster", "row_id", "hash"]].assign(of_fitting=False))
            some = least(batch.loc[batch["fits"], ["cluster", "row_id", "hash"]].assign(of_fitting=True))
            drawn = least(pd.concat([x for x in (drawn, every, some) if len(x)]))
            if len(ranges) + len(drawn) > _SKETCH_LINES:
                yield lines(ranges, drawn)
                ranges, drawn = None, empty
        if ranges is not None:
            yield lines(ranges, drawn)

    hashed = keys.select("cluster", "row_id", "fits", seeded_hash(F.col("row_id"), seed).alias("hash"))
    return hashed.mapInPandas(sketch, _SKETCH.format(kind))


def _middle_rows(keys: DataFrame, ranges: DataFrame, plan: DataFrame, width: int = 1 << 16) -> DataFrame:
    """``(cluster, middle)``: the row key of the pool at zero-based rank n // 2.

    Counts per key range find the range that holds it; only rows of that range
    are ranked.
    """
    counts = (
        ranges.join(plan.select("cluster", "fitting"), "cluster")
        .groupBy("cluster", "fitting", F.col("key_range").alias("_range"))
        .agg(F.sum(F.when(F.col("fitting"), F.col("n_fit")).otherwise(F.col("n"))).alias("_n"))
    )
    upto = W.partitionBy("cluster").orderBy("_range").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("cluster")
    target = F.floor(F.sum("_n").over(whole) / 2)
    holding = (
        counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
        .withColumn("_want", target - F.col("_before"))
        .where((F.col("_want") >= 0) & (F.col("_want") < F.col("_n")))
        .select("cluster", "_range", "_want", "fitting")
    )
    inside = W.partitionBy("cluster", "_range").orderBy("row_id")
    return (
        keys.withColumn("_range", F.floor(F.col("row_id") / F.lit(width)))
        .join(holding, ["cluster", "_range"])
        .where(F.col("fits") | ~F.col("fitting"))
        .withColumn("_rank", F.row_number().over(inside) - 1)
        .where(F.col("_rank") == F.col("_want"))
        .select("cluster", F.col("row_id").alias("middle"))
    )


def label_prompts(picks: DataFrame) -> DataFrame:
    """``(cluster, prompt_lines)``: picked texts, cut and dashed, one per line."""
    ordered = F.array_sort(F.collect_list(F.struct("place", prompt_line(F.col("text")).alias("line"))))
    return picks.groupBy("cluster").agg(
        F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("prompt_lines")
    )


_SUFFIX = r"(?: \([0-9]+\))+$"


def dedup_labels(labels: DataFrame) -> DataFrame:
    """Make ``label`` unique ignoring case: later clusters get `` (1)``, `` (2)`` ...

    Labels can only clash within a family that shares its text once number
    suffixes are removed. Families without any suffix are numbered by rank,
    spread over key ranges; the rare others are walked in cluster order, one
    family at a time.
    """
    family = F.regexp_replace(F.lower("label"), _SUFFIX, "")
    rows = labels.withColumn("_family", family)
    mixed = rows.where(F.lower("label").rlike(_SUFFIX)).select("_family").distinct()
    plain = rows.join(mixed, "_family", "left_anti")
    ranked = rank_in_group(plain, ["_family"], "cluster", "_k")
    numbered = ranked.withColumn(
        "label",
        F.when(F.col("_k") == 0, F.col("label")).otherwise(
            F.concat("label", F.lit(" ("), F.col("_k").cast("string"), F.lit(")"))
        ),
    ).drop("_k", "_family")
    columns = numbered.columns
    schema = rows.select(*columns).schema

    def walk(family_rows: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        following: dict[str, int] = {}
        out = []
        ordered = family_rows.sort_values("cluster")
        for label in ordered["label"]:
            name, k = label, following.get(label, 1)
            while name.lower() in used:
                name, k = f"{label} ({k})", k + 1
            following[label] = max(1, k - 1)
            used.add(name.lower())
            out.append(name)
        return ordered.assign(label=out)[columns]

    walked = (
        rows.join(mixed, "_family", "left_semi").groupBy("_family").applyInPandas(walk, schema=schema)
    )
    return numbered.unionByName(walked)


Labeller = Callable[[list[str]], list[str | None]]


LABEL_ATTEMPTS = 3


def model_labels(
    prompts: DataFrame,
    labeller: Labeller,
    second: Labeller | None = None,
    attempts: int = LABEL_ATTEMPTS,
) -> DataFrame:
    """``(cluster, model_label)`` from a user's labeller; failures give null.

    The labeller gets a list of prompts and returns one answer per prompt. When a
    list fails, or an answer in it is blank, those prompts are asked one by one, with
    the second labeller from the second attempt on; a prompt that never succeeds
    loses only its own label.
    """
    later = second or labeller

    def one(prompt: str) -> str | None:
        for attempt in range(attempts):
            try:
                answer = list((labeller if attempt == 0 else later)([prompt]))[0]
            except Exception:
                continue
            if answer and str(answer).strip():
                return str(answer)
        return None

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch["prompt_lines"].tolist()
            try:
                answers = list(labeller(asked))
                if len(answers) != len(asked):
                    raise ValueError("one answer per prompt is needed")
            except Exception:
                answers = [None] * len(asked)
            answers = [a if a and str(a).strip() else one(q) for q, a in zip(asked, answers)]
            yield pd.DataFrame({"cluster": batch["cluster"], "model_label": pd.Series(answers, dtype=object)})

    kind = prompts.schema["cluster"].dataType.simpleString()
    asked = prompts.mapInPandas(ask, schema=f"cluster {kind}, model_label string")
    cleaned = clean_label(F.col("model_label"))
    return asked.select("cluster", F.when(F.length(cleaned) > 0, cleaned).alias("model_label"))


def category_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(cluster, col, val, n)`` over rows in clusters, blank values left out."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("col"), strip(F.col(f"`{c}`").cast("string")).alias("val"))
            for c in columns
        ]
    )
    return (
        rows.where(F.col("cluster") >= 0)
        .select("cluster", F.inline(pairs))
        .where(F.length("val") > 0)
        .groupBy("cluster", "col", "val")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def category_counts_wide(long: DataFrame, values: list[tuple[str, str]]) -> DataFrame:
    """One ``{col}__{val}_Count`` column for each listed pair; absent pairs are 0."""
    sums = [
        F.coalesce(F.sum(F.when((F.col("col") == c) & (F.col("val") == v), F.col("n"))), F.lit(0)).alias(
            f"{c.replace(' ', '_')}__{v.replace(' ', '_')}_Count"
        )
        for c, v in values
    ]
    return long.groupBy("cluster").agg(*sums)


def _written(rows: DataFrame, columns: list[str]) -> DataFrame:
    """What a summary reads of ``rows``, written once: it is read many times, and rows may come from joins.

    Only texts of rows in a cluster are needed, unless the text is a category itself.
    """
    text = F.col("text") if "text" in columns else F.when(F.col("cluster") >= 0, F.col("text"))
    others = [F.col("`" + c.replace("`", "``") + "`").cast("string").alias(c) for c in dict.fromkeys(columns) if c not in ("row_id", "cluster", "text")]
    return cut_lineage(rows.select("row_id", "cluster", text.alias("text"), *others))


def cluster_summary(
    rows: DataFrame,
    labeller: Labeller | None = None,
    category_columns: list[str] | str | None = None,
    second_labeller: Labeller | None = None,
) -> DataFrame:
    """Label, keywords, size and samples of each cluster that has a text.

    Columns: Cluster_ID, Cluster_Label, Top_Keywords, Message_Count,
    Sample_Messages, then one count per value of the category columns: those
    named, or with "auto" every column of 2 to 200 values.
    """
    auto = [c for c in rows.columns if c not in NOT_CATEGORIES]
    named_columns = auto if category_columns == "auto" else category_columns or []
    rows = _written(rows, named_columns)
    msgs = messages(rows)
    sizes = msgs.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    keywords = keyword_lists(top_keywords(msgs))
    joined = (
        sizes.join(keywords, "cluster", "left")
        .join(sample_messages(msgs), "cluster", "left")
        .withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
        .withColumn("label", title_label(F.col("keywords"), F.col("cluster")))
    )
    if labeller is not None:
        # Clusters of fewer than three texts get a numbered name and no keywords.
        small = F.col("n") < 3
        asked = representatives(msgs.join(sizes.where(~small).select("cluster"), "cluster", "left_semi"))
        answers = model_labels(label_prompts(asked), labeller, second_labeller)
        none = F.array().cast("array<string>")
        joined = (
            joined.join(answers, "cluster", "left")
            .withColumn("keywords", F.when(small, none).otherwise(F.col("keywords")))
            .withColumn(
                "label",
                F.when(small, title_label(none, F.col("cluster"))).otherwise(
                    F.coalesce("model_label", "label")
                ),
            )
            .drop("model_label")
        )
    joined = cut_lineage(joined)  # one line per cluster, used several times below
    named = dedup_labels(joined.select("cluster", "label"))
    out = joined.drop("label").join(named, "cluster")
    result = out.select(
        F.col("cluster").alias("Cluster_ID"),
        F.col("label").alias("Cluster_Label"),
        F.array_join("keywords", ", ").alias("Top_Keywords"),
        F.col("n").alias("Message_Count"),
        F.col("samples").alias("Sample_Messages"),
    )
    if category_columns:
        # Values are those of the whole table, noise included.
        found = summary_columns(rows, named_columns).orderBy("column").collect() if named_columns else []
        pairs = [(r["column"], v) for r in found for v in r["values"]]
        if pairs:
            long = category_counts(rows, [r["column"] for r in found])
            wide = category_counts_wide(long, pairs)
            counts = [c for c in wide.columns if c != "cluster"]
            result = result.join(
                wide.withColumnRenamed("cluster", "Cluster_ID"), "Cluster_ID", "left"
            ).fillna(0, counts)
    return result


def by_size(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("Message_Count"), F.asc("Cluster_ID"))
