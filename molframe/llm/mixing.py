"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by source, language and topic. The weights of these cells are raked: scaled in turn so that the
source, language and topic totals meet their targets, until all do. A document's weight is its cell's factor, and it is
drawn with a probability in proportion to that factor, so the expected tokens of the sample follow the targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import WORD, cut, packed

MARGINS = ("source", "lang", "topic")
SWEEPS = 4
#: cells up to this number are broadcast to the documents, beyond it they are joined by shuffle
SMALL = 100_000


def topic_of(text: Column) -> Column:
    """The kind of a text by its marks: table, noise, list or prose; empty without any word."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda marks: F.regexp_count(text, F.lit(f"[{marks}]")) / n
    return F.when(F.length(text) == 0, "empty").when(share("|") > 0.02, "table").when(share("*#%$&@") > 0.05, "noise").when(share("\\n") > 0.02, "list").otherwise("prose")


def flattened(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Targets of a margin: its shares of all tokens, raised to `power` and scaled to one; every value keeps a share."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).select(margin, F.pow("t", F.lit(power)).alias("p"))
    return sums.select(margin, (F.col("p") / F.sum("p").over(W.Window.partitionBy(F.lit(0)))).alias("target"))


def rake(cells: DataFrame, tolerance: float = 1e-6, most: int = 12) -> DataFrame:
    """`cells` (tokens, the margins, and a target for each: target_source, ...) with `weight`, the fitted token share.

    Sweeps end when all targets are met. Where targets contradict each other (a source that has one language only, say)
    no weights meet them all: sweeps then end when weights no longer move, or after `most` rounds of SWEEPS, and the topic
    targets, raked last, are met while the others are as near as that allows."""
    cur = cells.withColumn("weight", F.col("tokens") / F.sum("tokens").over(W.Window.partitionBy(F.lit(0))))
    off = lambda m: F.abs(F.sum("weight").over(W.Window.partitionBy(m)) - F.col(f"target_{m}"))
    for _ in range(most):
        cur = cur.withColumn("before", F.col("weight"))
        for _ in range(SWEEPS):
            for m in MARGINS:
                cur = cur.withColumn("weight", F.col("weight") * F.col(f"target_{m}") / F.sum("weight").over(W.Window.partitionBy(m)))
        cur = cut(cur.withColumn("off", F.greatest(*map(off, MARGINS))).withColumn("moved", F.abs(F.col("weight") - F.col("before"))))
        missed, moved = cur.agg(F.max("off"), F.max("moved")).first()
        cur = cur.drop("off", "before", "moved")
        if (missed or 0) <= tolerance or (moved or 0) <= tolerance:
            break
    return cur


def _seen(docs: DataFrame, topic: Column | None) -> list[Column]:
    """The margins of a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [*(F.coalesce(F.col(c), F.lit("none")).alias(c) for c in MARGINS[:2]), (topic_of(text) if topic is None else topic).alias("topic")]


def with_draw(docs: DataFrame, power: float = 0.9, seed: int = 7, topic: Column | None = None) -> DataFrame:
    """(text, row, source, lang, topic, tokens, weight, probability, kept) for every row of `docs`; see `mix`. `row` holds
    all columns but the text, whatever their names (`common.unpacked`). Rows stay where they are: only the cells' weights
    are joined to them."""
    tokens = F.greatest(F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)), F.lit(1)).cast("long").alias("tokens")
    base = packed(docs, "text", *_seen(docs, topic), tokens)
    cells = cut(base.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    small = F.broadcast if cells.count() <= SMALL else lambda df: df
    with_targets = cells
    for m in MARGINS:
        with_targets = with_targets.join(small(flattened(cells, m, power).withColumnRenamed("target", f"target_{m}")), m)
    fitted = rake(with_targets)
    ratio = fitted.select(*MARGINS, (F.col("weight") * F.sum("tokens").over(W.Window.partitionBy(F.lit(0))) / F.col("tokens")).alias("weight"))
    ratio = ratio.withColumn("probability", F.col("weight") / F.max("weight").over(W.Window.partitionBy(F.lit(0))))
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("row.doc_id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return base.join(small(ratio), list(MARGINS)).withColumn("kept", drawn < F.col("probability"))


def mix(docs: DataFrame, power: float = 0.9, seed: int = 7, topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, weight, probability, kept) for every row of `docs`.

    Targets are the margins' token shares raised to `power`: below one, rare sources, languages and topics gain. `weight`
    is fitted share over counted share; `probability` is weight over the largest weight, so the most wanted cell is kept
    whole; `kept` compares it with a number that doc_id and `seed` fix. Null sources and languages count as the value
    `none`. A document without words has one token, so it has a weight like the others of its cell. Rows that repeat a
    doc_id are kept or dropped together. An empty table gives an empty result. Other columns are not read."""
    drawn = with_draw(docs.select("doc_id", "text", *MARGINS[:2]), power, seed, topic)
    return drawn.select("row.doc_id", *MARGINS, "tokens", "weight", "probability", "kept")
