"""Exact deduplication by an extendible-hash index on shared files, in Spark expressions only.

The index holds one entry for each different text, in the bucket that the first bits of its hash name. The directory
starts with one bucket; a bucket with more than `capacity` entries is split by one bit more, and where that bit goes
beyond the directory, the directory doubles. Splitting stops at MAX_BITS. Entries are distinct texts, so copies never
overfill a bucket: they are combined before the shuffle. An owner task holds a range of buckets; entries whose hashes
collide are told apart by their bytes and chained. The index is written in key order to spark.checkpoint.dir."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import GAP, cut

MAX_BITS = 20


def normalised(text: str = "text") -> Column:
    """Each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), GAP, " ")


def directory(hashes: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) for each of the 2**bits slots in use, and bits. `bucket` is its first slot."""
    hashes = hashes.select("h").distinct()
    bits = min(MAX_BITS, max(0, math.ceil(math.log2(max(1, hashes.count()) / capacity)) + 3))
    slots = hashes.groupBy(slot_of(bits).alias("slot")).agg(F.count("*").alias("n"))
    # at most 2**MAX_BITS slots, each at every depth
    deep = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    deep = deep.withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {bits} - depth), {bits} - depth)"))
    held = deep.withColumn("held", F.sum("n").over(W.Window.partitionBy("depth", "bucket")))
    fits = held.filter((F.col("held") <= capacity) | (F.col("depth") == bits))
    return fits.groupBy("slot").agg(F.min(F.struct("depth", "bucket")).alias("at")).select("slot", "at.bucket", "at.depth"), bits


def slot_of(bits: int) -> Column:
    return F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)


def build_index(docs: DataFrame, capacity: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """The index (bucket, depth, h, chain, text_sha256, n_bytes, keep_id, group_size) and the documents' keys
    (doc_id, h, text_sha256), both as tables in the shared folder."""
    text = docs.select("doc_id", normalised().alias("norm")).withColumn("h", F.xxhash64("norm"))
    keys = cut(text.select("doc_id", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")))
    slots, bits = directory(keys, capacity)
    placed = text.withColumn("slot", slot_of(bits)).join(F.broadcast(slots), "slot")  # 2**MAX_BITS rows at most
    entries = placed.groupBy("bucket", "depth", "h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = entries.select("bucket", "depth", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.octet_length("norm").cast("long").alias("n_bytes"), "keep_id", "group_size")
    chained = entries.withColumn("chain", F.row_number().over(W.Window.partitionBy("bucket", "h").orderBy("text_sha256")) - 1)
    return cut(chained.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h", "chain")), keys


def dedup(docs: DataFrame, capacity: int = 65_536) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of `docs`.

    Texts are equal when they are after each run of white space has become one space; null counts as empty. Of equal
    texts the smallest doc_id is kept; rows that repeat a doc_id share its fate; a row without doc_id is never kept. An
    empty table gives an empty result. Other columns are not read."""
    index, keys = build_index(docs, capacity)
    found = keys.join(index.select("h", "text_sha256", "keep_id", "group_size"), ["h", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
