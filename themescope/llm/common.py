"""Shared pieces of the text operators: passes over texts in Arrow, folds, label tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a task handles at once (a single longer text is handled alone).
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(column: str, n: int):
    """crc32 of the id written as text, modulo ``n``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def text_key(column: str = "text") -> list:
    """Two 64-bit digests that stand for a text (null counts as empty)."""
    text = F.coalesce(F.col(column), F.lit(""))
    return [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text, F.lit(2)).alias("d2")]


def raw_texts(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null becomes b''."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about CHUNK_BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    part = (np.cumsum(sizes) - sizes) // CHUNK_BYTES
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    for start, end in zip(edges, [*edges[1:], len(sizes)], strict=True):
        yield batch.slice(start, end - start)


def per_text(
    df: DataFrame, keep: list[str], fields: list[T.StructField], start: Callable[[], Callable], text: str = "text"
) -> DataFrame:
    """One row out for each row in: the columns of ``keep`` and new ``fields``.

    ``start()`` runs once in each task and returns a function from a list of texts (bytes)
    to one list or array for each field.
    """
    kept = df.select(*keep) if keep else df.select()
    schema = T.StructType([*kept.schema.fields, *fields])
    names = [f.name for f in schema.fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        work = start()
        for batch in batches:
            for part in slices(batch, "__text"):
                made = work(raw_texts(part.column("__text")))
                columns = [part.column(i) for i in range(len(keep))]
                columns += [pa.array(x, type=k) for x, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if ":" in kind or "<" in kind else KINDS[kind])


KINDS = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "binary": T.BinaryType(), "longs": T.ArrayType(T.LongType()),
    "ints": T.ArrayType(T.IntegerType()), "doubles": T.ArrayType(T.DoubleType()),
}


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) with one row an id: the largest label of repeated rows; nulls go."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(column).cast("int")).alias("label"))
    )


def lowest(df: DataFrame, by: str, n: int) -> dict:
    """For each value of ``by`` the hash (column ``__h``) up to which about ``n`` of its rows lie.

    Hashes are spread evenly, so the limit follows from the number of rows alone: nothing is
    sorted, and one value may hold most rows. All rows where there are n or fewer.
    """
    counts = df.groupBy(by).agg(F.count("*").alias("n")).collect()  # one row a value
    return {r[by]: (1 << 63) - 1 if r["n"] <= n else -(1 << 63) + (n << 64) // r["n"] for r in counts}
