"""Modified residues of files that do not say which entities are polymers: told by their atoms and their bond to a neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.functions import chemistry as chem
from molframe.plans.spatial import pairs_between
from molframe.session import cut

RESIDUE = ["entry", "chain", "seq", "icode", "resname"]
#: bonds between neighbours: the atom of the one before, that of the next, and their greatest distance
LINKS = (("O3'", "P", 2.0), ("C", "N", 2.5))


def told_by_atoms(names: Column) -> Column:
    """nucleic or protein by a set of atom names: a sugar with C1', C4' and O4' and a phosphate or O3'; N, CA and C."""
    has = lambda *parts: F.size(F.array_intersect(names, F.array(*map(F.lit, parts)))) == len(parts)
    return F.when(has("C1'", "C4'", "O4'") & (has("P") | has("O3'")), "nucleic").when(has("N", "CA", "C"), "protein")


def linked_types(atoms: DataFrame) -> DataFrame:
    """`atoms` with `entity_type`: `polymer` for residues of no standard name that are made like one and bonded to a neighbour in the chain,
    where the file itself gives no type; other rows keep theirs (null without one). So PSU in a strand is a nucleotide and ATP beside it a
    ligand. Only chains with such residues are looked at."""
    # read several times here, so a file is parsed once and the atoms are written
    a = cut(atoms if "entity_type" in atoms.columns else atoms.withColumn("entity_type", F.lit(None).cast("string")))
    odd = a.filter(F.col("entity_type").isNull() & chem.polymer_kind(F.col("resname")).isNull() & ~F.col("resname").isin([*chem.WATER, "DUM"]))
    odd = odd.groupBy(*RESIDUE).agg(F.collect_set("atom").alias("_names")).withColumn("_kind", told_by_atoms(F.col("_names"))).filter("_kind is not null").select(*RESIDUE, "_kind")
    odd = cut(odd)
    if odd.isEmpty():
        return a
    ends = a.filter(F.col("atom").isin("O3'", "P", "C", "N")).select(*RESIDUE, "atom", "idx", "x", "y", "z")
    core = a.filter(F.col("atom").isin("C1'", "CA")).select(*RESIDUE, F.when(F.col("atom") == "CA", "protein").otherwise("nucleic").alias("_kind")).distinct()
    mine = ends.join(odd, RESIDUE)
    near = ends.join(odd.select("entry", "chain").distinct(), ["entry", "chain"], "left_semi").join(core, RESIDUE)
    bond = F.lit(False)
    for last, first, r in LINKS:
        way = ((F.col("atom_a") == last) & (F.col("atom_b") == first)) | ((F.col("atom_a") == first) & (F.col("atom_b") == last))
        bond = bond | (way & (F.col("distance") <= r))
    other = (F.col("seq_a") != F.col("seq_b")) | (F.col("icode_a") != F.col("icode_b"))
    pairs = pairs_between(mine, near, max(r for *_, r in LINKS), ["entry", "chain"], where=other & (F.col("_kind_a") == F.col("_kind_b")) & bond)
    linked = cut(pairs.select("entry", "chain", *[F.col(c + "_a").alias(c) for c in RESIDUE[2:]]).distinct().withColumn("_linked", F.lit(True)))
    j = a.join(linked, RESIDUE, "left")
    kind = F.coalesce("entity_type", F.when(F.col("_linked"), F.lit("polymer")))
    return j.select(*[kind.alias(c) if c == "entity_type" else F.col(c) for c in a.columns])
