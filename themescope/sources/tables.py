"""Table, report and parameter sinks with the matching readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Our own tables: Parquet, schema taken as written."""
    return spark.read.parquet(path)


def read_outside_csv(spark: SparkSession, path: str) -> DataFrame:
    """A user's own table: types inferred, as for any foreign CSV."""
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')


def stack(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows, then new ones; columns matched by name, missing ones null."""
    return old.unionByName(new, allowMissingColumns=True)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None when there is no such path; other errors pass."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_table(df: DataFrame, path: str, dedup_on: str | None = None) -> None:
    """Add rows to a Parquet table. A rerun adds them again unless ``dedup_on`` is given."""
    if dedup_on:
        old = _existing(df.sparkSession, path)
        if old is not None:
            df = df.join(old.select(dedup_on), dedup_on, "left_anti")
    df.write.mode("append").option("mergeSchema", True).parquet(path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """Read an appended table whose batches may have different columns."""
    return spark.read.option("mergeSchema", True).parquet(path)


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """CSV with header; the first header carries a byte order mark when asked for."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Text report from ``(order columns..., line)``; part files are in line order."""
    order = [c for c in lines.columns if c != "line"]
    lines.orderBy(*order).select(F.coalesce("line", F.lit("")).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def save_chosen_k(spark: SparkSession, k: int, path: str) -> None:
    spark.createDataFrame([(int(k),)], "k int").write.mode("overwrite").parquet(path)


def load_chosen_k(spark: SparkSession, path: str) -> int | None:
    """The stored k, or None when nothing was stored yet."""
    stored = _existing(spark, path)
    row = None if stored is None else stored.first()
    return None if row is None else int(row["k"])


def rename_legacy(df: DataFrame) -> DataFrame:
    """Old files said Topic where newer ones say Cluster."""
    for part in ("Label", "ID"):
        if f"Cluster_{part}" not in df.columns and f"Topic_{part}" in df.columns:
            df = df.withColumnRenamed(f"Topic_{part}", f"Cluster_{part}")
    return df


def coerce_comparison(df: DataFrame) -> DataFrame:
    """Counts, percents and the difference as numbers; anything else becomes null."""
    numeric = [
        c for c in df.columns if c.endswith("_Count") or c.endswith("_Percent") or c == "Difference"
    ]
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in numeric})
