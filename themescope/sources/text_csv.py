"""CSV input as plain strings, with row ids that follow file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_BAD_BYTE = "\ufffd"


def read_text_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Every column a string; undecodable bytes removed; ``row_id`` in file order.

    Large files are split. Quoted line breaks need ``multi_line``, which makes one
    task per file.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("inferSchema", False)
        .option("enforceSchema", True)
        .csv(path)
    )
    if not raw.columns:
        raise ValueError(f"{path} has no header row or is empty")
    clean = raw.select(
        *[
            F.regexp_replace(F.col(_quoted(c)), _BAD_BYTE, "").alias(c.lstrip("\ufeff"))
            for c in raw.columns
        ],
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    return _number_blocks(clean)


def with_row_id(df: DataFrame) -> DataFrame:
    """Dense ``row_id`` from 0 in file order for a table just read from files."""
    located = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    return _number_blocks(located)


def _number_blocks(located: DataFrame) -> DataFrame:
    # Rows of one file block are read in order by one task, so the running id
    # counts them; only one line per block is needed to shift blocks in place.
    rows = located.withColumn("_seq", F.monotonically_increasing_id())
    before = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        rows.groupBy("_file", "_block")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
        .select(
            "_file",
            "_block",
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        )
    )
    return (
        rows.join(blocks, ["_file", "_block"])
        .withColumn("row_id", F.col("_seq") + F.col("_shift"))
        .drop("_file", "_block", "_seq", "_shift")
    )


def preview(df: DataFrame, n: int) -> DataFrame:
    """Bounded look at the first rows; the scan stops early."""
    return df.limit(n)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
