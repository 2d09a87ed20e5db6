"""Pairs of chains whose second is the first one moved, so that their scores are known beforehand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from molframe import bindings as B
from molframe.functions.geom import snap
from molframe.operators import chain_scores as C
from molframe.registry.base import query, with_

NAMES = ("A", "C", "D", "E", "F", "G", "H", "I", "K", "L")


def two_chains(spark, sf, apart: float):
    """Chain a: the vectors of a label; b: a quarter turn and a shift of it, without every fifth residue, every eleventh renamed
    and every seventh `apart` off along z. With their alignment."""
    p = B.points(spark, sf).select(F.col("chain").alias("pair"), F.col("idx").alias("seq"), "x", "y", "z")
    p = p.withColumn("letter", F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.pmod("seq", F.lit(10)) + 1).cast("int"))).withColumn("icode", F.lit(""))
    kept = F.col("seq") % 5 != 0
    b = p.filter(kept).select("pair", "seq", (F.lit(10.0) - F.col("y")).alias("x"), (F.col("x") + 20.0).alias("y"), (F.col("z") + 30.0 + F.when(F.col("seq") % 7 == 0, apart).otherwise(0.0)).alias("z"),
                              F.when(F.col("seq") % 11 == 0, F.lit("W")).otherwise(F.col("letter")).alias("letter"), "icode")
    both = p.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    place = F.row_number().over(Window.partitionBy("pair", "side").orderBy("seq")) - 1
    chains = both.withColumn("pos", place.cast("bigint")).withColumn("resname", F.col("letter"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("seq"), c.alias("l")))), lambda r: r["l"]), "")
    other = F.when(~kept, F.lit("-")).when(F.col("seq") % 11 == 0, F.lit("W")).otherwise(F.col("letter"))
    rows = p.groupBy("pair").agg(text(F.col("letter")).alias("a"), text(other).alias("b"))
    rows = rows.select("pair", F.explode(F.array(F.struct(F.lit(1).alias("row"), F.col("a").alias("seq")), F.struct(F.lit(2).alias("row"), F.col("b").alias("seq")))).alias("r")).select("pair", "r.*")
    return chains, rows


PAIRED = with_(B.PTS, """res AS (SELECT chain AS pair, count(*) AS length, count(*) FILTER (idx % 5 <> 0) AS aligned, count(*) FILTER (idx % 5 <> 0 AND idx % 11 <> 0) AS identical,
    count(*) FILTER (idx % 5 <> 0 AND idx % 7 <> 0) AS core, greatest(0.5, 1.24 * cbrt(greatest(count(*) - 15.0, 0.0)) - 1.8) AS scale FROM pts GROUP BY chain)""")
_GRID = lambda c: f"floor(({c}) * 1000000 + 0.5) / 1000000 + 0.0"


@query("chain_pair_scores", "J15 A7", PAIRED + f"""SELECT pair, 'file' AS method, aligned, {_GRID("aligned / length")} AS tm, 0.0 AS rmsd, {_GRID("identical / aligned")} AS identity FROM res""")
def by_alignment(spark, sf):
    chains, rows = two_chains(spark, sf, 0.0)
    s = C.scores_by_alignment(chains, rows, 10)
    return s.select("pair", "method", "aligned", snap(F.col("tm"), 1e6).alias("tm"), "rmsd", snap(F.col("identity"), 1e6).alias("identity"))


# the rigid part is laid exactly on its image, the rest is 1,000 away
@query("chain_pair_scores_by_number", "J15 J3", PAIRED + f"""SELECT pair, 'sequence' AS method, aligned,
    {_GRID("(core + (aligned - core) * (floor(1.0 / (1.0 + (1000.0 / scale) * (1000.0 / scale)) * 1048576.0 + 0.5) / 1048576.0)) / length")} AS tm, {_GRID("identical / aligned")} AS identity FROM res""")
def by_number(spark, sf):
    chains, _ = two_chains(spark, sf, 1000.0)
    s = C.scores_by_numbering(chains, 1)
    return s.select("pair", "method", "aligned", snap(F.col("tm"), 1e6).alias("tm"), snap(F.col("identity"), 1e6).alias("identity"))
