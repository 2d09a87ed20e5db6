"""Forms of the batch operators for data that keeps arriving. Each gives what its batch twin gives over the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from molframe.session import checkpoint_dir
from molframe.sources.structures import entry_of


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_now(stream: DataFrame, mode: str = "append", state: bool = False, progress: list | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it emitted, with `batch`, from the checkpoint folder.

    Every batch is a folder of its own, replaced when the batch is run again after a failure, so rows come once. `state` keeps state
    in RocksDB; each batch's report is added to `progress`."""
    spark = stream.sparkSession
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    if state:
        spark.conf.set(store, ROCKS)
    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    q = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/log").trigger(availableNow=True)
        .foreachBatch(keep).start()
    )
    spark.conf.set(store, before)
    q.awaitTermination()
    if progress is not None:
        progress.extend(q.recentProgress)
    return spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).parquet(f"{root}/out")


def latest(out: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of every key of an update or complete stream."""
    cols = [c for c in out.columns if c not in (*keys, "batch")]
    g = out.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("v"))
    return g.select(*keys, "v.*")


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New structure files of a folder as lines with their entry, each file once (stateless)."""
    d = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return d.select(entry_of(folder).alias("entry"), "value")


def stream_structures(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Atom records of new PDB-format files."""
    d = stream_lines(spark, folder, files_per_trigger).filter(F.col("value").rlike("^(ATOM  |HETATM)"))
    cut = lambda a, b: F.trim(F.substring("value", a, b - a + 1))
    return d.select("entry", cut(22, 22).alias("chain"), cut(23, 26).try_cast("int").alias("seq"), cut(18, 20).alias("resname"), cut(13, 16).alias("atom"),
                    *[cut(31 + 8 * i, 38 + 8 * i).try_cast("double").alias(c) for i, c in enumerate("xyz")])


def stream_dedupe(stream: DataFrame, time: str, content: list[str], ttl: str) -> DataFrame:
    """First arrival of every content hash; the same content within `ttl` is ignored."""
    d = stream.withWatermark(time, ttl).withColumn("hash", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in content]), 256))
    return d.dropDuplicatesWithinWatermark(["hash"])


def stream_outcomes(stream: DataFrame, time: str, window: str, late: str, keys: list[str]) -> DataFrame:
    """Outcome counts per key and tumbling window; a late row within the watermark corrects its window (update mode)."""
    d = stream.withWatermark(time, late)
    g = d.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), *keys, "n")


def stream_sessions(stream: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Contiguous runs of a key, split where the gap is longer than `gap`."""
    g = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("residues"))
    return g.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "residues")


def stream_expiring_misses(stream: DataFrame, key: str, time: str, ttl_seconds: float) -> DataFrame:
    """Per key, the requests that are really asked: a remembered 'no result' is trusted for the given time, then asked
    again. State is one time stamp a key; rows of a key are taken in time order within a batch."""

    def ask(name: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        asked = []
        times = pd.concat([r[["t"]] for r in rows])["t"].sort_values()
        for t in times:
            if last is None or t - last > ttl_seconds * 1e6:
                asked.append(int(t))
                last = int(t)
        state.update((last,))
        yield pd.DataFrame({"key": [name[0]] * len(asked), "asked": asked})

    d = stream.select(F.col(key).alias("key"), F.unix_micros(F.col(time)).alias("t"))
    return d.groupBy("key").applyInPandasWithState(ask, "key bigint, asked bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)
