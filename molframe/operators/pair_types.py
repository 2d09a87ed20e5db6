"""What a pair of entries of one protein can stand for: with and without ligand, one and several copies, open and closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.functions.geom import snap
from molframe.operators.superpose import kabsch

OPEN = 3.0
LEAST = 30


def entry_pairs(features: DataFrame) -> DataFrame:
    """accession, entry_a, entry_b: every two entries of an accession once, the lower name first. As many as the square of an
    accession's entries; hand `pair_types` a list of pairs where that is too many."""
    side = lambda t: features.select("accession", F.col("entry").alias("entry" + t))
    return side("_a").join(side("_b"), "accession").filter("entry_a < entry_b")


def trace_rmsd(pairs: DataFrame, traces: DataFrame, least: int = LEAST) -> DataFrame:
    """entry_a, entry_b, aligned, rmsd: CA RMSD over the residues of one number after superposition, null where fewer than `least` are
    common. traces: entry, seq, icode, x, y, z of each entry's first protein chain. All pairs are fitted in one aggregate."""
    a = traces.select(F.col("entry").alias("entry_a"), "seq", "icode", "x", "y", "z")
    b = traces.select(F.col("entry").alias("entry_b"), "seq", "icode", *[F.col(c).alias(d) for c, d in zip("xyz", "uvw")])
    fit = kabsch(pairs.select("entry_a", "entry_b").distinct().join(a, "entry_a").join(b, ["entry_b", "seq", "icode"]), ["entry_a", "entry_b"])
    return fit.select("entry_a", "entry_b", F.col("n").alias("aligned"), F.when(F.col("n") >= least, snap(F.col("rmsd"))).alias("rmsd"))


def pair_types(features: DataFrame, traces: DataFrame, pairs: DataFrame | None = None, least: int = LEAST, open_: float = OPEN) -> DataFrame:
    """accession, entry_a, entry_b, rmsd, types (sorted; none is an empty list).

    apo/holo: a ligand touches one of the two only; monomer/oligomer: one has one chain in its first assembly, the other several;
    open/closed: alike in ligands and an RMSD of `open_` or more. Only pairs alike in ligands are superposed; the RMSD of others is
    null. features: entry, accession, ligand_touching, assembly_chains."""
    p = entry_pairs(features) if pairs is None else pairs
    side = lambda t: features.select(F.col("entry").alias("entry" + t), F.col("ligand_touching").alias("l" + t), F.col("assembly_chains").alias("c" + t))
    d = p.join(side("_a"), "entry_a").join(side("_b"), "entry_b")
    alike = d.filter("l_a = l_b").select("entry_a", "entry_b")
    d = d.join(trace_rmsd(alike, traces, least).drop("aligned"), ["entry_a", "entry_b"], "left")
    several = (F.least("c_a", "c_b") == 1) & (F.greatest("c_a", "c_b") >= 2)
    kinds = F.array(
        F.when(F.col("l_a") != F.col("l_b"), "apo/holo"), F.when(several, "monomer/oligomer"), F.when((F.col("l_a") == F.col("l_b")) & (F.col("rmsd") >= open_), "open/closed")
    )
    return d.select("accession", "entry_a", "entry_b", "rmsd", F.array_compact(kinds).alias("types"))


def type_counts(types: DataFrame) -> DataFrame:
    """accession, type, pairs: how many pairs of each accession can stand for each type."""
    return types.select("accession", F.explode("types").alias("type")).groupBy("accession", "type").agg(F.count(F.lit(1)).alias("pairs"))
