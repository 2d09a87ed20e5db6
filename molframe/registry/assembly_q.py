"""Assemblies whose chains are known copies of a cloud of vectors: their symmetry, screws and protomers follow from how they are made."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe import bindings as B
from molframe.functions.geom import snap
from molframe.operators import assembly as A
from molframe.operators import symmetry as S
from molframe.registry.base import query, with_

#: how far a cloud lies from the axis
OUT = 70.0


def clouds(spark, sf, parts: int = 1):
    """entry (label), part, seq, x, y, z: the vectors of a label beside the axis, once for each protein, six apart."""
    p = B.points(spark, sf).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return p.select(F.col("chain").alias("entry"), "part", F.col("idx").alias("seq"), (F.col("x") + OUT).alias("x"), (F.col("y") + 10.0).alias("y"), (F.col("z") + 25.0 + F.col("part") * 6.0).alias("z"))


def copies(p, count, turn, up, flip):
    """`count` copies of every cloud, each turned by `turn` degrees about z and raised by `up`; with `flip` as many again, turned over."""
    d = p.withColumn("_k", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("_f", F.explode(F.when(flip, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    y, z = F.when(F.col("_f") == 1, -F.col("y")).otherwise(F.col("y")), F.when(F.col("_f") == 1, -F.col("z")).otherwise(F.col("z"))
    t = F.radians(turn * F.col("_k"))
    k = F.col("_k") + F.col("_f") * count
    d = d.select(
        "entry", F.concat(F.element_at(F.array(F.lit("A"), F.lit("B")), (F.col("part") + 1).cast("int")), k.cast("string")).alias("chain"), F.col("seq").cast("int").alias("seq"), F.lit("").alias("icode"),
        F.concat(F.lit("R"), F.pmod(F.col("seq") * (F.col("part") * 4 + 1), F.lit(13)).cast("string")).alias("resname"), (F.col("part").cast("bigint") * 1_000_000_000 + k * 10_000_000 + F.col("seq")).alias("idx"),
        snap(F.col("x") * F.cos(t) - y * F.sin(t)).alias("x"), snap(F.col("x") * F.sin(t) + y * F.cos(t)).alias("y"), snap(z + up * F.col("_k")).alias("z"),
    )
    return d


def order():
    return F.lit(2) + F.pmod("entry", F.lit(4))


def odd():
    return F.pmod("entry", F.lit(2)) == 1


ENT = with_("ent AS (SELECT DISTINCT label::BIGINT AS entry, (2 + label % 4)::INT AS n FROM embeddings)")


@query("assembly_symmetry", "J9 J11", ENT + "SELECT entry, CASE WHEN entry % 2 = 1 THEN 'D' ELSE 'C' END || n AS symbol, n, 1.0 AS along_z, 0.0 AS rmsd FROM ent")
def assembly_symmetry(spark, sf):
    """Rings of two to five copies, every second one doubled to a dihedral; a D2 has three equal axes, of which any may come out."""
    r = copies(clouds(spark, sf), order().cast("int"), F.lit(360.0) / order(), F.lit(0.0), odd())
    g = S.cyclic_symmetry(r, A.chain_copies(r)).groups
    along = F.when(F.col("symbol") == "D2", F.greatest(*[F.abs(f"axis.{c}") for c in "xyz"])).otherwise(F.abs("axis.z"))
    return g.select("entry", "symbol", "n", snap(along).alias("along_z"), snap(F.col("rmsd"), 100.0).alias("rmsd"))


@query("assembly_screws", "J10", ENT + "SELECT entry, (20.0 + 5 * n) * CASE WHEN entry % 2 = 1 THEN -1 ELSE 1 END AS twist, 4.0 + n AS rise, CASE WHEN entry % 2 = 1 THEN 'left' ELSE 'right' END AS hand, 6 AS copies, 1::BIGINT AS paths FROM ent")
def assembly_screws(spark, sf):
    turn = (F.lit(20.0) + order() * 5) * F.when(odd(), F.lit(-1.0)).otherwise(F.lit(1.0))
    r = copies(clouds(spark, sf), F.lit(6), turn, F.lit(4.0) + order(), F.lit(False))
    g, _ = S.helical_symmetry(r, A.chain_copies(r))
    return g.select("entry", snap(F.col("twist"), 10.0).alias("twist"), snap(F.col("rise"), 10.0).alias("rise"), "hand", "copies", "paths")


@query("assembly_protomers", "J17", ENT + "SELECT entry, 'A' || k || ',B' || k AS chains FROM (SELECT entry, unnest(range(n)) AS k FROM ent)")
def assembly_protomers(spark, sf):
    """Two proteins that share a cloud go together in every copy of it."""
    r = copies(clouds(spark, sf, 2), order().cast("int"), F.lit(360.0) / order(), F.lit(0.0), F.lit(False)).cache()
    c = A.chain_copies(r)
    p = S.protomers(r, c, S.cyclic_symmetry(r, c))
    return p.groupBy("entry", "protomer").agg(F.array_join(F.array_sort(F.collect_list("chain")), ",").alias("chains")).select("entry", "chains")
