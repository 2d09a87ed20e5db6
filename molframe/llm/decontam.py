"""Benchmark decontamination by spaced seeds, in Spark expressions only.

A seed is the hash of the words under a fixed mask; words at the mask's gaps may differ. Seeds of the benchmark are joined
with those of the documents. Around each hit the document's words are laid along the item's, and a pair counts as a leak
if in some WINDOW words in a row (or the whole item, if shorter) at least `least` of the words agree, each in its place.
So single words may be replaced; words put in or left out end a window and begin another alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP

#: every placing of three replaced words in 13 or more, and of one in 7, leaves some mask a place
MASKS = ("1101011", "1110101", "10110011", "11111")
WINDOW = 13
#: seeds of a benchmark up to this number are broadcast, at 50 bytes each at most; a larger one is joined by shuffle
SMALL = 2_000_000


def word_hashes(text: str = "text") -> Column:
    """Hashes of the lower-cased words; a text that begins with white space has the empty word first."""
    return F.transform(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), GAP), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each seed of column `words`: `keep`, `at` (the seed's first word) and `seed`."""
    each = rows.select(*keep, "words", F.posexplode("words").alias("at", "_"))
    under = []
    for i, mask in enumerate(MASKS):
        words = [F.get("words", F.col("at") + p) for p, bit in enumerate(mask) if bit == "1"]
        under.append(F.when(F.col("at") + len(mask) <= F.size("words"), F.xxhash64(F.lit(i), *words)))
    return each.select(*keep, "at", F.explode(F.array(*under)).alias("seed")).filter("seed is not null")


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.75) -> DataFrame:
    """(doc_id, item_id, matched, item_words, overlap): every document and item of which the document holds a passage.

    `matched` counts the item's words that agree along the best alignment, `overlap` the share in its best window. Items
    of fewer words than the shortest mask have no seeds and are not found; null texts are empty. Documents that repeat an
    id give one row for each item. An empty table gives an empty result. Other columns are not read."""
    items = benchmark.select("item_id", F.array_remove(word_hashes(), F.xxhash64(F.lit(""))).alias("words"))
    tests = seeds(items.withColumn("n", F.size("words")), ["item_id", "n"]).withColumnRenamed("at", "item_at").distinct()
    small = F.broadcast if tests.count() <= SMALL else lambda df: df
    found = seeds(docs.select("doc_id", word_hashes().alias("words")), ["doc_id", "words"]).join(small(tests), "seed")
    shift = F.col("at") - F.col("item_at")
    hits = found.select("doc_id", "item_id", shift.alias("shift"), F.slice("words", F.greatest(shift, F.lit(0)) + 1, F.col("n") + F.least(shift, F.lit(0))).alias("there"))
    hits = hits.dropDuplicates(["doc_id", "item_id", "shift"])
    both = hits.join(small(items), "item_id")
    # a shift below 0: the item's first words would stand before the text
    before = F.greatest(-F.col("shift"), F.lit(0))
    agree = F.transform("words", lambda w, i: F.coalesce(F.get("there", i - before) == w, F.lit(False)).cast("int"))
    laid = both.select("doc_id", "item_id", agree.alias("agree"), F.least(F.size("words"), F.lit(WINDOW)).alias("window"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    windows = F.transform(F.sequence(F.lit(1), F.size("agree") - F.col("window") + 1), lambda i: total(F.slice("agree", i, F.col("window"))))
    scored = laid.select("doc_id", "item_id", total("agree").alias("matched"), F.size("agree").alias("item_words"), (F.array_max(windows) / F.col("window")).alias("overlap"))
    best = scored.filter(F.col("overlap") >= least).groupBy("doc_id", "item_id").agg(F.max(F.struct("overlap", "matched", "item_words")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.matched").cast("long").alias("matched"), F.col("b.item_words").cast("long").alias("item_words"), "b.overlap")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.75) -> DataFrame:
    """The rows of `docs` that hold no passage of the benchmark; rows without doc_id stay."""
    return docs.join(leaks(docs, benchmark, least).select("doc_id").distinct(), "doc_id", "left_anti")
