"""Fill-in-the-middle rearrangement of texts, cut between whole words at places drawn from the document's id.

A text's units are its words with the whitespace before them, and what whitespace is left at the end. The texts of a
batch lie one after the other in blocks of BLOCK bytes. A Fenwick tree over the blocks holds how many units end and how
many code points begin in each; a binary-lifting descent finds the block where the wanted unit ends, and only that
block is searched for the place. Cuts are counted in code points, so Spark's own functions cut and join the texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import flat

BLOCK = 1024
#: bytes of text worked on at a time, at least one text
PORTION = 1 << 22
#: blocks searched at a time
LOCAL = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUTS = StructType([StructField(c, LongType()) for c in ("n", "prefix_chars", "middle_chars")])


class Fenwick:
    """Prefix sums over blocks: node i holds the sum of the lowbit(i) blocks that end with block i."""

    def __init__(self, counts: np.ndarray):
        total = np.concatenate([[0], np.cumsum(counts)])
        node = np.arange(len(total))
        self.node = total - total[node - (node & -node)]
        self.step = 1 << max(0, len(counts).bit_length() - 1)

    def before(self, block: np.ndarray) -> np.ndarray:
        """The sum of the blocks before each given one."""
        at, total = block.astype(np.int64).copy(), np.zeros(len(block), dtype=np.int64)
        while at.any():
            total += np.where(at > 0, self.node[at], 0)
            at -= at & -at
        return total

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block in which each wanted (from 1) counted item lies, and the sum of the blocks before it."""
        block, left = np.zeros(len(wanted), dtype=np.int64), wanted.astype(np.int64).copy()
        step = self.step
        while step:
            on = block + step
            go = on < len(self.node)
            value = self.node[np.minimum(on, len(self.node) - 1)]
            go &= value < left
            block[go] = on[go]
            left[go] -= value[go]
            step >>= 1
        return block, wanted - left


def unit_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a unit ends with each byte: the last byte of a word, or the last of a text that ends with whitespace."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    last = np.zeros(len(data), dtype=bool)
    last[at[1:][np.diff(at) > 0] - 1] = True
    follow = np.append(space[1:], True)
    return last | (~space & follow)


def cuts(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the code points before its two cuts: the smaller and the larger of low, high modulo n + 1."""
    ends = unit_ends(data, at)
    begins = (data & 0xC0) != 0x80  # of code points
    pad = -len(data) % BLOCK
    in_blocks = lambda mark: np.pad(mark, (0, pad)).reshape(-1, BLOCK)
    end_blocks, begin_blocks = in_blocks(ends), in_blocks(begins)
    units, points = Fenwick(end_blocks.sum(axis=1)), Fenwick(begin_blocks.sum(axis=1))

    def before(byte: np.ndarray, tree: Fenwick, blocks: np.ndarray) -> np.ndarray:
        """How many are marked before each byte."""
        block, inner = byte // BLOCK, byte % BLOCK
        out = tree.before(np.minimum(block, len(tree.node) - 1))
        for i in range(0, len(byte), LOCAL):
            some = slice(i, i + LOCAL)
            whole = blocks[np.minimum(block[some], len(blocks) - 1)] if len(blocks) else np.zeros((len(byte[some]), BLOCK), bool)
            out[some] += (whole & (np.arange(BLOCK) < inner[some, None])).sum(axis=1)
        return out

    first = before(at, units, end_blocks)
    n = np.diff(first)
    one, two = low % (n + 1), high % (n + 1)
    k = np.concatenate([np.minimum(one, two), np.maximum(one, two)])
    place = np.tile(at[:-1], 2)
    inside = np.flatnonzero(k > 0)
    block, passed = units.find(np.tile(first[:-1], 2)[inside] + k[inside])
    rest = np.tile(first[:-1], 2)[inside] + k[inside] - passed
    for i in range(0, len(inside), LOCAL):
        some = slice(i, i + LOCAL)
        run = end_blocks[block[some]].cumsum(axis=1)
        place[inside[some]] = block[some] * BLOCK + (run == rest[some, None]).argmax(axis=1) + 1
    chars = before(np.concatenate([at[:-1], place]), points, begin_blocks)
    begin, a, b = np.split(chars, 3)
    return n, a - begin, b - begin


@F.arrow_udf(CUTS)
def find_cuts(text: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    """Units and code points up to the cuts of each text (UTF-8), worked on in portions of PORTION bytes."""
    out = [[np.zeros(0, np.int64)] * 3]
    data, at = flat(text)
    low_, high_ = low.to_numpy(zero_copy_only=False), high.to_numpy(zero_copy_only=False)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(at, at[i] + PORTION, side="right")) - 1)
        out.append(cuts(data[at[i] : at[j]], at[i : j + 1] - at[i], low_[i:j], high_[i:j]))
        i = j
    n, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b - a, pa.int64())], names=["n", "prefix_chars", "middle_chars"])


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2 to the 32 from the id."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def rearranged(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null where plain), output; a row for each row of `docs`.

    `rate` of 100 texts are rearranged, `spm` of 100 of these with the suffix first. A null or empty text, and one that
    holds a mark already, stays plain; a null text counts as empty. A null id draws as an empty one. Equal rows give equal
    results. Only doc_id and text are read; an empty table gives an empty one. The longest text is held by one task."""
    h = draws(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("body")).select("doc_id", "body", find_cuts(F.col("body").cast("binary"), h[0], h[1]).alias("cut"))
    body, first, middle = F.col("body"), F.col("cut.prefix_chars"), F.col("cut.middle_chars")
    marked = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    plain = (body == "") | marked | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    piece = lambda start, n: F.substring(body, start.cast("int"), n.cast("int"))
    p, m, s = piece(F.lit(1), first), piece(first + 1, middle), piece(first + middle + 1, F.length(body))
    output = F.when(F.col("form") == "plain", body).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m))
    output = output.otherwise(F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
    cut_only = lambda c: F.when(F.col("form") != "plain", c)
    return d.withColumn("form", form).select(
        "doc_id", F.col("cut.n").alias("n"), "form", cut_only(first).alias("prefix_chars"), cut_only(middle).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text that a rearranged one was made from. No piece holds a mark, so the first of each is the one that was put in."""
    piece = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(piece[1], piece[3], piece[2])).otherwise(F.concat(piece[2], piece[3], piece[1]))
