"""What several of the operators share: tables, text columns, the shared folder, and raw text in Arrow batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.session import cut  # noqa: F401  writes to spark.checkpoint.dir and reads again

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(text: str = "text") -> Column:
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def packed(docs: DataFrame, *beside: Column | str) -> DataFrame:
    """Columns `beside` and a struct `row` of all columns of `docs` but `text`, so that no name of theirs can clash."""
    return docs.select(*beside, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` again, from `text` and `row`."""
    return rows.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def parts(spark: SparkSession) -> int:
    """The number of shuffle partitions, by which the caller scales a job to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_key(df: DataFrame, key: str) -> DataFrame:
    """`df` as a table bucketed by `key` in the warehouse: later joins on `key` leave its rows where they are."""
    name = f"by_key_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").bucketBy(parts(df.sparkSession), key).saveAsTable(name, format="parquet")
    release(df.sparkSession)
    return df.sparkSession.table(name)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where each value begins (one more for the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    at = np.frombuffer(places, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def as_binary(data: bytes | np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column of the pieces of `data` between the places `at`."""
    if isinstance(data, np.ndarray):
        data = data.tobytes()
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, dtype=np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def slices(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all elements of the slices, one slice after the other, and where each slice begins among them."""
    at = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=at[1:])
    return np.arange(at[-1], dtype=np.int64) + np.repeat(starts - at[:-1], lengths), at


def portions(batches: Iterator[pa.RecordBatch], column: str = "body", most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, at least one row each."""
    for b in batches:
        if not b.num_rows:
            continue
        _, at = flat(b.column(column))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
            yield b.slice(i, j - i)
            i = j
