"""Alignments: rows (family, row, seq); gaps are the characters that are not A-Z.

Texts are cut into blocks of BLOCK columns in the scan, and every step works on a block at once: counts and masses of
(column, letter) are summed as arrays, first inside each map task and then by (family, block); a row's share of a block's
columns is one sum over the block's array. Single letters are never shuffled, and a block bounds every task however long
a text or large a family is."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.functions.chemistry import SIMILAR
from molframe.functions.geom import snap

WGRID = 1e6
BLOCK = 1024
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: rows of a family that meet one copy of a block's array; beyond it the array is copied
TOGETHER = 2000
#: arrays that a map task holds before it hands them on
HELD = 128


def explode_letters(seqs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Cells of ungapped-left rows (family, row, seq); '-' cells are left out."""
    cells = seqs.select("family", "row", *keep, F.posexplode(F.split("seq", "")).alias("col", "letter"))
    return cells.filter(F.col("letter").rlike("[A-Z]"))


def blocks(seqs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """family, row, block, piece: the texts in blocks of columns, as bytes."""
    # one pass over the text: a substring is counted from its beginning each time
    cut = F.regexp_extract_all("seq", F.lit(f"(?s)(.{{1,{BLOCK}}})"), F.lit(1))
    return seqs.select("family", "row", *keep, F.posexplode(cut).alias("block", "piece")).withColumn("piece", F.col("piece").cast("binary"))


def _cells(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Columns and letters (0-25) of a piece."""
    letter = np.frombuffer(piece, dtype=np.uint8).astype(np.int64) - 65
    col = np.flatnonzero((letter >= 0) & (letter < 26))
    return col, letter[col]


def _sums(pieces: DataFrame, weight: str | None, finish, schema: str) -> DataFrame:
    """The array (BLOCK x 26) of each family and block, counts or sums of `weight`, through `finish(array)`, which returns
    columns; `schema` names family, block and those."""
    kind = np.float64 if weight else np.int64

    def out(held: dict) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=1)
        keys = sorted(held)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([squeeze.compress(held[k].tobytes()) for k in keys], pa.binary())], names=["family", "block", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            rows = [b.column(c).to_pylist() for c in ("family", "block", "piece", *([weight] if weight else []))]
            for family, block, piece, *w in zip(*rows, strict=True):
                if (family, block) not in held:
                    if len(held) == HELD:
                        yield out(held)
                        held = {}
                    held[family, block] = np.zeros(BLOCK * 26, dtype=kind)
                col, letter = _cells(piece)
                held[family, block][col * 26 + letter] += w[0] if weight else 1
        if held:
            yield out(held)

    def total(t: pa.Table) -> pa.Table:
        whole = np.zeros(BLOCK * 26, dtype=kind)
        for part in t.column("part").to_pylist():
            whole += np.frombuffer(zstandard.decompress(part), dtype=kind)
        made = finish(whole.reshape(BLOCK, 26), t.column("block")[0].as_py())
        n = len(next(iter(made.values())))
        return pa.table({"family": pa.array([t.column("family")[0].as_py()] * n), "block": pa.array([t.column("block")[0].as_py()] * n, pa.int32()), **made})

    return pieces.mapInArrow(add, "family string, block int, part binary").groupBy("family", "block").applyInArrow(total, schema)


def column_counts(seqs: DataFrame) -> DataFrame:
    """family, col, present, types, top, grouped: letters in the column, kinds of them, the commonest one's count, and the
    count of the commonest similarity group."""

    def finish(k: np.ndarray, block: int) -> dict:
        col = np.flatnonzero(k.sum(axis=1))
        k = k[col]
        grouped = np.max([k[:, [LETTERS.index(x) for x in g]].sum(axis=1) for g in SIMILAR], axis=0) if len(col) else np.zeros(0, np.int64)
        top = k.max(axis=1) if len(col) else np.zeros(0, np.int64)
        return {"col": pa.array((col + block * BLOCK).astype(np.int32)), "present": pa.array(k.sum(axis=1)), "types": pa.array((k > 0).sum(axis=1)), "top": pa.array(top), "grouped": pa.array(grouped)}

    return _sums(blocks(seqs), None, finish, "family string, block int, col int, present long, types long, top long, grouped long").drop("block")


def column_classes(seqs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Strict and similar columns: one letter in every row; one letter or similarity group in 0.7 of all rows."""
    n = seqs.groupBy("family").agg(F.count(F.lit(1)).alias("rows"))
    j = column_counts(seqs).join(n, "family")
    strict = (F.col("present") == F.col("rows")) & (F.col("types") == 1)
    share = F.greatest("top", "grouped") / F.col("rows")
    return j.select("family", "col", "present", "types", strict.alias("strict"), (~strict & (share >= threshold)).alias("similar"))


def henikoff_weights(seqs: DataFrame) -> DataFrame:
    """family, row, weight: each letter type of a column shares 1/types equally among its carriers; 1 in all."""

    def shares(k: np.ndarray, block: int) -> dict:
        types = (k > 0).sum(axis=1, keepdims=True)
        share = np.divide(1.0, types * k, out=np.zeros(k.shape), where=k > 0)
        return {"share": pa.array([zstandard.compress(share.tobytes(), 1)], pa.binary())}

    pieces = blocks(seqs)
    made = _sums(pieces, None, shares, "family string, block int, share binary")
    # a large family's rows are dealt over copies of the array
    copies = pieces.groupBy("family", "block").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("copies"))
    dealt = pieces.join(copies, ["family", "block"]).withColumn("copy", F.pmod(F.xxhash64("row"), F.col("copies")).cast("int"))
    arrays = made.join(copies, ["family", "block"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))

    def weigh(rows: pa.Table, arrays: pa.Table) -> pa.Table:
        share = np.frombuffer(zstandard.decompress(arrays.column("share")[0].as_py()), dtype=np.float64) if arrays.num_rows else np.zeros(BLOCK * 26)
        w = []
        for piece in rows.column("piece").to_pylist():
            col, letter = _cells(piece)
            w.append(float(share[col * 26 + letter].sum()))
        return pa.table({"family": rows.column("family"), "row": rows.column("row"), "w": pa.array(w, pa.float64())})

    key = ["family", "block", "copy"]
    schema = f"family string, row {seqs.schema['row'].dataType.simpleString()}, w double"
    parts = dealt.select(*key, "row", "piece").groupBy(*key).cogroup(arrays.select(*key, "share").groupBy(*key)).applyInArrow(weigh, schema)
    w = parts.groupBy("family", "row").agg(F.sum("w").alias("w"))
    whole = w.groupBy("family").agg(F.sum("w").alias("total"))
    n = seqs.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    out = seqs.select("family", "row").join(w, ["family", "row"], "left").join(n, "family").join(whole, "family", "left")
    even = F.lit(1.0) / F.col("n")
    return out.select("family", "row", F.when(F.col("total") > 0, F.coalesce("w", F.lit(0.0)) / F.col("total")).otherwise(even).alias("weight"))


def conservation(seqs: DataFrame, weighted: bool = True) -> DataFrame:
    """family, col, conservation: 1 - entropy / log 20 of the letters present, scaled by the mass present."""
    if weighted:
        s = seqs.join(henikoff_weights(seqs), ["family", "row"])
    else:
        s = seqs.join(seqs.groupBy("family").agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight")), "family")

    def finish(m: np.ndarray, block: int) -> dict:
        present = m.sum(axis=1)
        col = np.flatnonzero(present > 0)
        m, present = m[col], present[col]
        entropy = np.log(present) - (m * np.log(np.where(m > 0, m, 1.0))).sum(axis=1) / present
        raw = (1.0 - entropy / math.log(20)) * present
        return {"col": pa.array((col + block * BLOCK).astype(np.int32)), "conservation": pa.array(np.clip(raw, 0.0, 1.0))}

    return _sums(blocks(s, ["weight"]), "weight", finish, "family string, block int, col int, conservation double").drop("block")


def grades(df: DataFrame, keys: list[str], score: str, step: float = 0.5) -> DataFrame:
    """`df` with `grade` 1..9 by z-score in bins of half a standard deviation; 0 for null, 5 when all are alike."""
    s = df.groupBy(*keys).agg(F.avg(score).alias("_m"), F.stddev_pop(score).alias("_s"))
    j = df.join(s, keys)
    z = (F.col(score) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    g = F.least(F.lit(9), F.greatest(F.lit(1), F.floor(z / F.lit(step) + 0.5).cast("int") + 5))
    grade = F.when(F.col(score).isNull(), F.lit(0)).when(F.col("_s") < 1e-9, F.lit(5)).otherwise(g)
    return j.withColumn("grade", grade.cast("int")).drop("_m", "_s")


def conservation_to_residues(scores: DataFrame, seqs: DataFrame, chains: DataFrame, least: float = 0.5) -> DataFrame:
    """Column scores on the residues of every chain at least half identical to a row; the best row wins.

    `chains`: family, chain, pos (0-based place in the chain), letter, and `offset` (place in the row minus place in
    the chain; 0 for shared numbering). Rows and chains are paired by place and letter, so only equal cells meet."""
    cells = explode_letters(seqs)
    w = Window.partitionBy("family", "row").orderBy("col")
    rows = cells.withColumn("place", F.row_number().over(w) - 1)
    at = chains.withColumn("place", F.col("pos") + F.coalesce("offset", F.lit(0)))
    size = chains.groupBy("family", "chain").agg(F.count(F.lit(1)).alias("n"))
    same = rows.join(at, ["family", "place", "letter"]).groupBy("family", "chain", "row").agg(F.count(F.lit(1)).alias("same"))
    best = same.groupBy("family", "chain").agg(F.min(F.struct((-F.col("same")).alias("k"), "row")).alias("b"))
    best = best.join(size, ["family", "chain"]).filter(-F.col("b.k") >= F.lit(least) * F.col("n"))
    pick = at.join(best.select("family", "chain", F.col("b.row").alias("row")), ["family", "chain"])
    j = pick.select("family", "chain", "pos", "row", "place").join(rows.select("family", "row", "place", "col"), ["family", "row", "place"])
    return j.join(scores, ["family", "col"]).select("family", "chain", "pos", "row", "col", "conservation")


def identity(pairs: DataFrame, group: list[str], a: str, b: str) -> Column:
    return F.count_if(F.col(a) == F.col(b)) / F.count(F.lit(1))


def one_protein(pairs: DataFrame, group: list[str], a: str, b: str, shorter: str) -> DataFrame:
    """Identity >= 0.9 over the aligned residues and identical ones >= half of the shorter chain."""
    n = pairs.groupBy(*group).agg(
        F.count(F.lit(1)).alias("aligned"), F.count_if(F.col(a) == F.col(b)).alias("identical"), F.max(shorter).alias("shorter")
    )
    same = (F.col("identical") >= F.lit(0.9) * F.col("aligned")) & (F.col("identical") * 2 >= F.col("shorter"))
    return n.select(*group, "aligned", "identical", same.alias("one_protein"))


snap_weight = lambda c: snap(c, WGRID)
