"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced together.

Groups of equal texts are placed one by one, largest first, each into the shard where the dot product of its size vector
with the shard's residual capacity is highest. One task packs BLOCK groups at most. More are packed block by block into
a few bins for each shard, and the bins are packed again as groups of the next level; a group too large for a
block's bins is handed up as it is. A group larger than half a shard in
any size is split into sixteenths of a shard in that size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import WORD, cut

BLOCK = 8192
SIZES = ("bytes", "tokens", "rows")
CHUNK = 50_000
#: bins of a block for each shard: the next level packs them like groups, so they are to be small
FINER = 8


def pack(vectors: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each vector, all of whose totals are to be equal. Where a vector fits in no bin any more, it goes where
    most of the first size is left, so that size ends nearest to equal."""
    total = vectors.sum(axis=0)
    share = vectors / np.where(total > 0, total, 1)
    left = np.full((bins, share.shape[1]), 1.0 / bins)
    out = np.empty(len(share), dtype=np.int32)
    for i in np.lexsort((np.arange(len(share)), -share.sum(axis=1))):
        fits = (left >= share[i]).all(axis=1)
        best = int(np.argmax(np.where(fits, left @ share[i], -1.0))) if fits.any() else int(np.argmax(left[:, 0]))
        left[best] -= share[i]
        out[i] = best
    return out


def _pack_block(bins: int, level: int, last: bool):
    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("unit")
        vectors = np.column_stack([rows.column(c).to_numpy() for c in SIZES]).astype(float)
        total = vectors.sum(axis=0)
        small = np.ones(len(vectors), dtype=bool) if last else (vectors <= np.where(total > 0, total, 1) / (4 * bins)).all(axis=1)
        parent = rows.column("unit").to_numpy(zero_copy_only=False).astype(object)
        block = rows.column("block")[0].as_py()
        into = pack(vectors[small], bins)
        parent[small] = [str(x) if last else f"{level}/{block}/{x}" for x in into]
        return pa.table({"unit": rows.column("unit"), "parent": pa.array(parent, pa.string()), **{c: rows.column(c) for c in SIZES}})

    return work


def place(units: DataFrame, bins: int, block: int = BLOCK) -> DataFrame:
    """(unit, shard) for units with columns unit, bytes, tokens, rows.

    A block hands up FINER * bins bins and fewer than four times as many groups for each size, so a block of 32 times as
    many or more always leaves fewer groups for the next level."""
    block = max(block, 32 * FINER * bins)
    schema = "unit string, parent string, bytes long, tokens long, rows long"
    levels, cur = [], cut(units)
    while True:
        n = cur.count()
        last = n <= block
        blocked = cur.withColumn("block", F.lit(0) if last else F.pmod(F.xxhash64("unit"), F.lit(math.ceil(n / block))))
        packed = cut(blocked.groupBy("block").applyInArrow(_pack_block(bins if last else FINER * bins, len(levels), last), schema))
        levels.append(packed.select("unit", "parent"))
        if last:
            break
        cur = packed.groupBy(F.col("parent").alias("unit")).agg(*(F.sum(c).alias(c) for c in SIZES))
    out = levels.pop().select("unit", F.col("parent").cast("int").alias("shard"))
    while levels:
        out = levels.pop().join(out.withColumnRenamed("unit", "parent"), "parent").select("unit", "shard")
    return out


def slots(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """`rows` with a column `slot` that counts the rows of each shard from 0, made without a shard in one task."""
    chunks = max(1, math.ceil(rows.count() / chunk))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "chunk", (F.sum("n").over(W.Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("offset"))
    inner = F.row_number().over(W.Window.partitionBy("shard", "chunk").orderBy("doc_id")) - 1
    return rows.withColumn("inner", inner).join(offsets, ["shard", "chunk"]).withColumn("slot", (F.col("offset") + F.col("inner")).cast("long")).drop("chunk", "inner", "offset")


def shard(docs: DataFrame, bins: int = 8, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens) for every row of `docs`.

    The law is `bytes`: the shards' sizes (UTF-8 bytes plus one for each row) are near equal, and so are tokens and rows.
    Rows with equal texts are one group and share a shard, unless the group has more than half a shard's bytes, tokens
    or rows. A null text has
    no bytes and is no copy of an empty one. Rows that repeat a doc_id are placed and counted each. An empty table gives
    an empty result. Other columns are not read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("null")).alias("group"),
    )
    base = cut(base)
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    groups = base.groupBy("group").agg(*sums)
    total = base.agg(*sums).first()
    half = {c: max((total[c] or 0) / (2 * bins), 0.125) for c in SIZES}
    # groups above half a shard: fewer than 2 * bins for each size; their pieces are a sixteenth of a shard
    pieces = F.greatest(*(F.ceil(F.col(c) / F.lit(half[c] / 8)) for c in SIZES))
    large = groups.filter(" or ".join(f"{c} > {half[c]!r}D" for c in SIZES)).select("group", F.least(pieces, "rows").alias("pieces"))
    base = base.join(F.broadcast(large), "group", "left")
    base = base.withColumn("unit", F.when(F.col("pieces").isNull(), F.col("group")).otherwise(F.concat_ws("/", "group", F.pmod(F.xxhash64("doc_id"), F.col("pieces")))))
    units = base.groupBy("unit").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    placed = base.join(place(units, bins, block), "unit").select("doc_id", "size", "text_crc32", "tokens", "shard")
    return slots(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
