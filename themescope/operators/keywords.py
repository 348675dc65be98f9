"""Keyword and word counts per cluster or group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from themescope.functions.text import words
from themescope.functions.words import STOPWORDS
from themescope.operators.rows import first_in_group
from themescope.session import cut_lineage

#: Words that a task counts for each cluster or group, and in all.
COUNTERS = 20_000
_HELD = 1_000_000
#: Words that a task takes from its texts at once.
_WORDS = 250_000


def word_rows(rows: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """One row per word; the text itself is not carried along."""
    return rows.select(*keep, F.explode(words(F.col(text_col))).alias("word"))


def _merged(tables: list[pa.Table]) -> pa.Table:
    """(by, word, n, row_id) with one line for each by and word."""
    every = pa.concat_tables(tables)
    merged = every.group_by(["by", "word"]).aggregate([("n", "sum"), ("row_id", "min")])
    return merged.select(["by", "word", "n_sum", "row_id_min"]).rename_columns(["by", "word", "n", "row_id"])


def _pruned(table: pa.Table, counters: int) -> tuple[pa.Table, dict]:
    """Misra-Gries step: ``counters`` words a ``by`` are left, and what all counts of a ``by`` lose for that."""
    sizes = table.group_by("by").aggregate([("word", "count")])
    wide = sizes.filter(pc.greater(sizes.column("word_count"), counters)).column("by").to_pylist()
    lost: dict = {}
    for by in wide:
        mine = pc.is_null(table.column("by")) if by is None else pc.fill_null(pc.equal(table.column("by"), by), False)
        own, rest = table.filter(mine), table.filter(pc.invert(mine))
        n = own.column("n").to_numpy()
        loss = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])
        left = own.filter(pa.array(n > loss))
        left = left.set_column(2, "n", pc.subtract(left.column("n"), loss))
        table, lost[by] = pa.concat_tables([rest, left]), loss
    return table, lost


def _parts(batch: pa.RecordBatch):
    """The rows of a batch, as many at a time as have about _WORDS words: what is counted at once stays small."""
    many = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
    place = (np.cumsum(many) - many) // _WORDS
    first = np.flatnonzero(np.diff(place, prepend=-1))
    for a, b in zip(first, [*first[1:], len(many)], strict=False):
        yield batch.slice(a, b - a)


def _summaries(listed: DataFrame, kind: str, counters: int) -> DataFrame:
    """``(by, word, n, row_id, lost)`` of each task: at most ``counters`` words for each ``by``.

    ``listed``: (by, row_id, words). A line without a word tells how much any count of the task may lack.
    """

    def summarise(batches):
        held: list[pa.Table] = []
        lost: dict = {}
        by_kind, size, settled = None, 0, 0

        def prune():
            table, more = _pruned(_merged(held), counters)
            for by, loss in more.items():
                lost[by] = lost.get(by, 0) + loss
            return table

        def lines(table):
            yield from table.append_column("lost", pa.array(np.zeros(len(table), np.int64))).combine_chunks().to_batches()
            many = len(lost)
            empty = [pa.nulls(many, pa.string()), pa.array([0] * many, pa.int64()), pa.nulls(many, pa.int64())]
            arrays = [pa.array(list(lost), by_kind), *empty, pa.array(list(lost.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["by", "word", "n", "row_id", "lost"])
            lost.clear()

        for batch in (part for batch in batches for part in _parts(batch)):
            by_kind, lists = batch.schema.field(0).type, batch.column(2)
            sizes = pc.fill_null(pc.list_value_length(lists), 0)
            at = pa.array(np.repeat(np.arange(batch.num_rows), sizes.to_numpy()))
            ones = pa.array(np.ones(len(at), np.int64))
            words_ = {"by": batch.column(0).take(at), "word": lists.flatten(), "n": ones, "row_id": batch.column(1).take(at)}
            held.append(_merged([pa.table(words_)]))
            size += len(held[-1])
            if size > 2 * settled + 100_000:  # most words have been seen before
                held[:] = [prune()]
                size = settled = len(held[0])
                if size > max(_HELD, 2 * counters):
                    yield from lines(held.pop())
                    size = settled = 0
        if held:
            yield from lines(prune())

    return listed.mapInArrow(summarise, f"by {kind}, word string, n long, row_id long, lost long")


def _word_counts(rows: DataFrame, by: str, n: int, stopwords: list[str], counters: int) -> DataFrame:
    """``(by, word, n, row_id)``: exact counts and first rows of words that include the n most frequent of each ``by``.

    Tasks keep at most ``counters`` words each (Misra-Gries), so the shuffle does not grow with the
    vocabulary. A count lacks at most what the tasks lost, so words that even so stay below the
    n-th are out, and those that remain are counted in a second pass. Where nothing was lost the first
    counts are exact, and there is no second pass.
    """
    kind = rows.schema[by].dataType.simpleString()
    kept = F.filter(words(F.col("text")), lambda w: ~w.isin(stopwords)) if stopwords else words(F.col("text"))
    listed = rows.select(F.col(by).alias("by"), F.col("row_id").cast("bigint").alias("row_id"), kept.alias("words"))
    lines = cut_lineage(_summaries(listed, kind, counters))
    sums = (
        lines.where("word IS NOT NULL").groupBy("by", "word").agg(F.sum("n").alias("n"), F.min("row_id").alias("row_id"))
    )
    lost = lines.where("word IS NULL").groupBy("by").agg(F.sum("lost").alias("lost"))
    if lines.where("lost > 0").isEmpty():
        return sums
    sums = cut_lineage(sums)
    least = first_in_group(sums, ["by"], [F.desc("n")], n, "place").groupBy("by").agg(
        F.min("n").alias("least"), F.count(F.lit(1)).alias("found")
    )
    same = F.col("by").eqNullSafe(F.col("_by"))
    bounds = cut_lineage(
        least.join(lost.withColumnRenamed("by", "_by"), same, "left").select(
            F.col("by").alias("_by"), F.col("least"), "found", F.coalesce("lost", F.lit(0)).alias("lost")
        )
    )
    # a word that no task kept has at most ``lost``: the n-th must have more
    if not bounds.where((F.col("lost") > 0) & ((F.col("found") < n) | (F.col("least") <= F.col("lost")))).isEmpty():
        return _word_counts(rows, by, n, stopwords, counters * 8)
    possible = sums.join(bounds, same).where(F.col("n") + F.col("lost") >= F.col("least")).select("by", "word")
    possible = cut_lineage(possible)
    told = possible.select(F.col("by").alias("_by"), F.col("word").alias("_word"))
    each = listed.select("by", "row_id", F.explode("words").alias("word"))
    return (
        each.join(told, same & (F.col("word") == F.col("_word")))
        .groupBy("by", "word")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("row_id"))
    )


def top_keywords(
    rows: DataFrame, by: str = "cluster", n: int = 5, stopwords: list[str] = STOPWORDS, counters: int = COUNTERS
) -> DataFrame:
    """``(by, rank, word, n)``: most frequent words, ties to the one seen first.

    ``rows`` has ``by``, ``row_id`` and ``text``. Counting keeps the count and the
    first row of each word, both plain numbers. Only words tied in count and first row go
    back to that row's text to see which comes first in it.
    """
    counts = _word_counts(rows, by, n, stopwords, counters).withColumnRenamed("by", by)
    order = [F.desc("n"), F.asc("row_id")]
    same = W.partitionBy(by, "n", "row_id")
    leading = counts.withColumn("place", F.rank().over(W.partitionBy(by).orderBy(*order))).where(
        F.col("place") <= n
    )
    # A few lines per cluster: written once, so that the join below is planned
    # from its real size.
    leading = cut_lineage(leading.withColumn("_tied", F.count(F.lit(1)).over(same) > 1))
    tied = leading.where("_tied")
    placed = leading.where(~F.col("_tied")).withColumn("position", F.lit(0).cast("bigint"))
    if tied.limit(1).count():
        found = tied.join(rows.select("row_id", "text"), "row_id").withColumn(
            "position", F.array_position(words(F.col("text")), F.col("word"))
        )
        placed = placed.unionByName(found.drop("text"))
    return first_in_group(
        placed.select(by, "word", "n", "row_id", "position"), [by], [*order, F.asc("position")], n
    ).select(by, "rank", "word", "n")


def keyword_lists(top: DataFrame, by: str = "cluster") -> DataFrame:
    """``(by, keywords)`` in rank order from the output of ``top_keywords``."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return top.groupBy(by).agg(F.transform(ordered, lambda s: s["word"]).alias("keywords"))


def word_freq(
    rows: DataFrame, group_col: str, n: int = 100, stopwords: list[str] = STOPWORDS, counters: int = COUNTERS
) -> DataFrame:
    """``(grp, rank, word, n)``: the n most frequent words of each group, ties by name."""
    given = F.col("row_id") if "row_id" in rows.columns else F.lit(0)
    slim = rows.select(F.col(group_col).alias("grp"), given.cast("bigint").alias("row_id"), "text")
    counts = _word_counts(slim, "grp", n, stopwords, counters)
    return first_in_group(counts.withColumnRenamed("by", "grp"), ["grp"], [F.desc("n"), F.asc("word")], n).select(
        "grp", "rank", "word", "n"
    )
