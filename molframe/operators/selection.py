"""Parts of a structure that go with a choice of chains: the nucleic strands they touch, and stretches of these with their partners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.plans.graph import components
from molframe.session import cut


def strands_touching(contacts: DataFrame, pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """entry, strand: strands with a contact to a chosen protein chain, and all that are base-paired to one of these, directly or over
    other strands. contacts: entry, chain, strand; pairs: entry, strand_a, strand_b; chosen: entry, chain."""
    touched = cut(contacts.join(chosen.select("entry", "chain").distinct(), ["entry", "chain"], "left_semi").select("entry", "strand").distinct())
    two = pairs.filter("strand_a <> strand_b").select("entry", "strand_a", "strand_b").distinct()
    linked = cut(components(two, ["entry"], "strand_a", "strand_b").withColumnRenamed("node", "strand"))
    reached = linked.join(touched, ["entry", "strand"], "left_semi").select("entry", "component").distinct()
    return linked.join(reached, ["entry", "component"], "left_semi").select("entry", "strand").union(touched).distinct()


def contacts_of(contacts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Contacts of the chosen chains only."""
    return contacts.join(chosen.select("entry", "chain").distinct(), ["entry", "chain"], "left_semi")


def strands_of_chains(strands: DataFrame, chosen: DataFrame) -> DataFrame:
    """Strands (entry, chain, strand, ...) of the named nucleic chains, all their pieces."""
    return strands.join(chosen.select("entry", "chain").distinct(), ["entry", "chain"], "left_semi")


def touched_windows(touched: DataFrame, strands: DataFrame, pairs: DataFrame, flank: int = 6, rounds: int = 3) -> DataFrame:
    """entry, strand, first, last: of every strand with a touched place one stretch, from the first to the last touched place and `flank`
    on either side, grown to the base-pair partners of all that any stretch holds, `rounds` times.

    touched: entry, strand, pos; strands: entry, strand, lo, hi (its ends); pairs: entry, strand_a, pos_a, strand_b, pos_b."""
    t = touched.groupBy("entry", "strand").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).join(strands.select("entry", "strand", "lo", "hi"), ["entry", "strand"])
    w = cut(t.select("entry", "strand", F.greatest("lo", F.col("a") - flank).alias("first"), F.least("hi", F.col("b") + flank).alias("last")))
    side = lambda x, y: pairs.select("entry", F.col("strand" + x).alias("strand"), F.col("pos" + x).alias("pos"), F.col("strand" + y).alias("to"), F.col("pos" + y).alias("at"))
    both = cut(side("_a", "_b").unionByName(side("_b", "_a")))
    for _ in range(rounds):
        held = both.join(w, ["entry", "strand"]).filter("pos between first and last")
        new = held.groupBy("entry", F.col("to").alias("strand")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
        w = cut(w.unionByName(new).groupBy("entry", "strand").agg(F.min("first").alias("first"), F.max("last").alias("last")))
    return w


def crop_gaps(windows: DataFrame, strands: DataFrame) -> DataFrame:
    """entry, strand, first, last, before, after: the stretches with the places left out on either side of each in its strand."""
    return windows.join(strands.select("entry", "strand", "lo", "hi"), ["entry", "strand"]).select(
        "entry", "strand", "first", "last", (F.col("first") - F.col("lo")).alias("before"), (F.col("hi") - F.col("last")).alias("after")
    )
