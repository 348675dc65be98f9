"""Which columns hold text, which hold categories, which groups to compare."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themescope.functions.text import is_digits_only, parses_as_float, strip
from themescope.operators.rows import first_in_group

RESERVED = ("text", "Message", "Cluster", "cluster", "Cluster_ID", "Cluster_Label")
MAX_COMPARE_VALUES = 50
MAX_SUMMARY_VALUES = 200
SAMPLE_ROWS = 500

# One bit per hash value: a bitmap aggregate of fixed size per column.
_BITS = 32768
_HEAD_ROWS = 5000
# Kinds of values in the column test: 0 null, 1 digits only, else this.
_SOME_TEXT = 2


def _text(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`").cast("string")


def _per_column(df: DataFrame, columns: list[str], measure, name: str) -> DataFrame:
    """One pass over the table, one result row per column."""
    one_row = df.agg(*[measure(c).alias(f"m{i}") for i, c in enumerate(columns)])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias(name)) for i, c in enumerate(columns)]
    )
    return one_row.select(F.inline(pairs))


def is_text_column(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, is_text)``: any non-empty value that is not a number."""

    def measure(c: str) -> Column:
        value = strip(_text(c))
        return F.coalesce(F.max((F.length(value) > 0) & ~parses_as_float(value)), F.lit(False))

    return _per_column(df, columns or df.columns, measure, "is_text")


def detect_text_column(df: DataFrame, sample_rows: int = SAMPLE_ROWS) -> str:
    """The only column, or the only text-like one in the first rows; otherwise an error."""
    columns = [c for c in df.columns if c != "row_id"]
    if len(columns) == 1:
        return columns[0]
    head = df.select(*[F.col(f"`{c}`") for c in columns]).limit(sample_rows)
    found = [r["column"] for r in is_text_column(head, columns).collect() if r["is_text"]]
    if len(found) == 1:
        return found[0]
    if found:
        raise ValueError(f"several text columns, name one: {found}")
    raise ValueError(f"no text column found, name one of: {columns}")


def mostly_text_columns(
    df: DataFrame, key: str, columns: list[str] | None = None, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``(column, n_sampled, n_text)`` over the first non-null values of each column."""
    columns = columns or [c for c in df.columns if c != key]
    found = first_kinds(df, key, columns, sample_rows)
    counted = found.groupBy("place").agg(
        F.count(F.lit(1)).alias("n_sampled"), F.count(F.when(F.col("kind") == _SOME_TEXT, 1)).alias("n_text")
    )
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("place") + 1)
    return counted.select(
        name.alias("column"), "n_sampled", "n_text", (F.col("n_text") * 2 > F.col("n_sampled")).alias("is_text")
    )


def first_kinds(df: DataFrame, key: str, columns: list[str], n: int) -> DataFrame:
    """``(place, key, kind)``: what the first n non-null values of each column are, from one scan.

    The scan turns each value into one of three small numbers. A task keeps n lines a
    column, whatever the number of rows, and passes on those; the first n of them remain.
    """
    kinds = [
        F.when(_text(c).isNull(), 0).when(is_digits_only(_text(c)), 1).otherwise(_SOME_TEXT).cast("tinyint").alias(f"c{i}")
        for i, c in enumerate(columns)
    ]
    kind = df.schema[key].dataType.simpleString()

    def keep(batches):
        held: list[pa.Table | None] = [None] * len(columns)
        for batch in batches:
            keys = batch.column(0)
            for i in range(len(columns)):
                there = pc.greater(batch.column(i + 1), 0)
                new = pa.table({"key": keys.filter(there), "kind": batch.column(i + 1).filter(there)})
                every = new if held[i] is None else pa.concat_tables([held[i], new])
                held[i] = every.take(pc.sort_indices(every, [("key", "ascending")])[:n]) if len(every) > n else every
        for i, table in enumerate(held):
            if table is not None:
                place = pa.array([i] * len(table), pa.int32())
                yield from pa.table({"place": place, **dict(zip(table.column_names, table.columns, strict=True))}).to_batches()

    first = df.select(F.col(key).alias("key"), *kinds).mapInArrow(keep, f"place int, key {kind}, kind tinyint")
    return first_in_group(first, ["place"], [F.asc("key")], n, "line").drop("line")


def text_column_name(df: DataFrame) -> str | None:
    """``text``, else the older ``Message``, else None."""
    return next((c for c in ("text", "Message") if c in df.columns), None)


def category_values(
    df: DataFrame, low: int, high: int, columns: list[str] | None = None, skip: tuple = RESERVED
) -> DataFrame:
    """``(column, value)`` for columns with low..high distinct non-blank values.

    A fixed-size bitmap of value hashes is filled for all columns in one pass.
    Its bit count never exceeds the distinct count, so a column with more than
    ``high`` bits is out for certain; the few left are then counted exactly. The
    same test on the first rows comes first: it rules out columns of free text
    or ids before they are read in full.
    """
    columns = columns or [c for c in df.columns if c not in skip]

    def bits(c: str) -> Column:
        value = strip(_text(c))
        slot = F.pmod(F.xxhash64(value), F.lit(_BITS))
        return F.bitmap_count(F.bitmap_construct_agg(F.when(F.length(value) > 0, slot)))

    def within(rows: DataFrame, names: list[str], least: int) -> list[str]:
        found = _per_column(rows, names, bits, "bits").collect() if names else []
        return [r["column"] for r in found if least <= (r["bits"] or 0) <= high]

    head = df.select(*[F.col(f"`{c}`") for c in columns]).limit(_HEAD_ROWS)
    narrow = within(df, within(head, columns, 0), 1)
    if not narrow:
        return df.sparkSession.createDataFrame([], "column string, value string")
    distinct = (
        df.select(
            F.inline(
                F.array(
                    *[F.struct(F.lit(c).alias("column"), strip(_text(c)).alias("value")) for c in narrow]
                )
            )
        )
        .where(F.length("value") > 0)
        .distinct()
    )
    sizes = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    fitting = sizes.where(F.col("n").between(low, high)).select("column")
    return distinct.join(fitting, "column", "left_semi")


def compare_columns(df: DataFrame) -> DataFrame:
    """``(column, n_values)`` for columns fit to split a comparison by."""
    return (
        category_values(df, 2, MAX_COMPARE_VALUES).groupBy("column").agg(F.count(F.lit(1)).alias("n_values"))
    )


def compare_columns_quick(df: DataFrame, sample_rows: int = 1000) -> list[str]:
    """Candidates from the first rows only, with no lower bound on distinct values."""
    columns = [c for c in df.columns if c not in RESERVED]
    head = df.limit(sample_rows)
    counts = _per_column(head, columns, lambda c: F.count_distinct(_text(c)), "n").collect()
    return [r["column"] for r in counts if r["n"] <= MAX_COMPARE_VALUES]


def summary_columns(
    df: DataFrame,
    columns: list[str] | None = None,
    skip: tuple = ("Cluster", "cluster", "text", "Message"),
) -> DataFrame:
    """``(column, values)`` with the sorted values of each summary column."""
    return (
        category_values(df, 2, MAX_SUMMARY_VALUES, columns, skip)
        .groupBy("column")
        .agg(F.sort_array(F.collect_set("value")).alias("values"))
    )


def choose_group_column(df: DataFrame, named: str | None = None) -> str:
    if named is not None:
        if named not in df.columns:
            raise ValueError(f"no column {named!r}; there are {df.columns}")
        return named
    found = [r["column"] for r in compare_columns(df).collect()]
    if len(found) == 1:
        return found[0]
    raise ValueError(
        f"several category columns, name one: {sorted(found)}" if found else "no category column found, name one"
    )


def group_values(df: DataFrame, group_col: str) -> DataFrame:
    """Sorted distinct trimmed values."""
    value = strip(_text(group_col))
    return df.select(value.alias("grp")).where(F.col("grp").isNotNull()).distinct().orderBy("grp")


def asked_groups(asked: list[str]) -> list[str]:
    """Names split on commas, trimmed, in first-seen order."""
    parts = [p.strip() for a in asked for p in str(a).split(",")]
    return list(dict.fromkeys(p for p in parts if p))


def select_groups(df: DataFrame, group_col: str, asked: list[str] | None = None) -> list[str]:
    """Group names to compare; every asked-for name must occur, and two are needed."""
    if asked:
        names = asked_groups(asked)
        wanted = df.sparkSession.createDataFrame([(n,) for n in names], "grp string")
        present = keep_groups(df, group_col, names).select(strip(_text(group_col)).alias("grp")).distinct()
        missing = {r["grp"] for r in wanted.join(present, "grp", "left_anti").collect()}
        if missing:
            raise ValueError(f"not in {group_col!r}: {[n for n in names if n in missing]}")
    else:
        names = [r["grp"] for r in group_values(df, group_col).collect()]  # one short line per group
    if len(names) < 2:
        raise ValueError(f"{group_col!r} gives {names}; at least two groups are needed")
    return names


def keep_groups(df: DataFrame, group_col: str, groups: list[str]) -> DataFrame:
    return df.where(strip(_text(group_col)).isin(groups))


def clustered(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Rows in a cluster: a number of at least 0; anything unreadable is noise."""
    number = F.coalesce(_text(cluster_col).try_cast("double"), F.lit(-1.0))
    return df.where(number >= 0)


def groups_in_comparison(df: DataFrame) -> list[str]:
    """Group names read back from the count columns."""
    return [c.replace("_Count", "") for c in df.columns if c.endswith("_Count")]


def unpivot_counts(df: DataFrame, ids: list[str]) -> DataFrame:
    """Wide comparison to ``(ids..., grp, n)``."""
    names = groups_in_comparison(df)
    pairs = F.array(
        *[
            F.struct(F.lit(g).alias("grp"), F.col(f"`{g}_Count`").cast("bigint").alias("n"))
            for g in names
        ]
    )
    return df.select(*ids, F.inline(pairs))
