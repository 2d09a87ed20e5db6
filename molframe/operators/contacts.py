"""Contacts between residues, elements and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.plans.blocks import near_labels
from molframe.plans.spatial import pairs_within
from molframe.plans.tiles import touching_counts, units_touching

KINDS = ["hbond", "salt", "stack", "cation_pi", "hydrophobic"]


def element_contacts(residues: DataFrame, r: float = 8.0, least: int = 3) -> DataFrame:
    """CA pairs within `r` of every two elements, kept from `least`."""
    inside = residues.filter("element is not null").select("entry", "idx", "element", "x", "y", "z", F.lit(0).alias("kind_"))
    near = units_touching(inside, None, ["element"], ["element"], [[r]]).filter(F.col("pairs") >= least)
    return near.select(
        "entry", F.least("element_a", "element_b").alias("element_a"), F.greatest("element_a", "element_b").alias("element_b"),
        F.col("pairs").alias("ca_pairs"),
    )


def chain_contacts(residues: DataFrame, r: float = 8.0) -> DataFrame:
    """CA pairs within `r` of different chains, the lower chain first."""
    p = residues.select("entry", "chain", "idx", "element", "x", "y", "z")
    near = pairs_within(p, r, where=F.col("chain_a") != F.col("chain_b"))
    turn = F.col("chain_a") > F.col("chain_b")
    pick = lambda c, s, t: F.when(turn, F.col(c + t)).otherwise(F.col(c + s))
    cols = ["chain", "idx", "element"]
    return near.select(
        "entry", *[pick(c, "_a", "_b").alias(c + "_a") for c in cols], *[pick(c, "_b", "_a").alias(c + "_b") for c in cols],
        "distance",
    )


def chain_faces(residues: DataFrame, r: float = 8.0) -> DataFrame:
    """entry, chain_a, chain_b (the lesser first), contacts, residues_a, residues_b, element_pairs of every two chains with CA pairs within `r`.

    No pair of residues is a row: pairs and elements in touch are counted tile by tile, and the residues of either side are those that are near the
    other chain at all. A residue without an element is in no element pair."""
    p = residues.select("entry", "chain", "idx", "element", "x", "y", "z")
    alone = p.withColumn("kind_", F.lit(0)).withColumn("_alone", F.when(F.col("element").isNull(), F.col("idx")))
    met = touching_counts(alone, ["chain", "element", "_alone"], "chain", [[r]], named="element")
    ends = near_labels(p, r, "chain")
    low = F.col("chain") < F.col("other")
    sides = ends.groupBy("entry", F.least("chain", "other").alias("chain_a"), F.greatest("chain", "other").alias("chain_b")).agg(
        F.count_if(low).alias("residues_a"), F.count_if(~low).alias("residues_b")
    )
    key = ["entry", "chain_a", "chain_b"]
    return met.join(sides, key).select(*key, F.col("pairs").alias("contacts"), "residues_a", "residues_b", F.col("units").alias("element_pairs"))


def interfaces(faces: DataFrame, interactions: DataFrame, measure: str = "ca") -> DataFrame:
    """One row per pair of chains in contact or with an interaction: pairs, distinct residues on each side, element pairs, interactions of
    every kind. `faces` is what `chain_faces` gives; `interactions` has entry, chain_a, chain_b, kind and how many (`n`)."""
    key = ["entry", "chain_a", "chain_b"]
    one, two = F.least("chain_a", "chain_b"), F.greatest("chain_a", "chain_b")
    kind = F.translate("kind", "-", "_")
    held = interactions.filter("chain_a <> chain_b").groupBy("entry", one.alias("chain_a"), two.alias("chain_b")).agg(
        *[F.sum(F.when(kind == k, F.col("n")).otherwise(0)).alias(k) for k in KINDS]
    )
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return faces.join(held, key, "full").select(
        *key, F.lit(measure).alias("measure"), *[none(c) for c in ("contacts", "residues_a", "residues_b", "element_pairs", *KINDS)]
    )


def label_ncut(residues: DataFrame, r: float = 12.0, apart: int = 6) -> DataFrame:
    """Normalised cut of every label against the rest: contacts across over contacts touching it, both sides.

    `residues` has entry, idx, label. cut/assoc(label) + cut/assoc(rest), from one pass over the contacts."""
    near = pairs_within(residues.select("entry", "idx", "label", "x", "y", "z"), r, where=F.col("idx_b") - F.col("idx_a") >= apart)
    ends = near.withColumn("_s", F.col("label_a") == F.col("label_b")).select(
        "entry", F.explode(F.array("label_a", "label_b")).alias("label"), "_s"
    )
    per = ends.groupBy("entry", "label").agg(
        F.count(F.lit(1)).alias("degree"), F.count_if(~F.col("_s")).alias("cut")
    )
    whole = per.groupBy("entry").agg(F.sum("degree").alias("total"))
    d = per.join(whole, "entry")
    cut = F.col("cut").cast("double")
    rest = F.nullif(F.col("total") - F.col("degree"), F.lit(0))
    return d.select("entry", "label", "cut", "degree", (cut / F.col("degree") + cut / rest).alias("ncut"))
