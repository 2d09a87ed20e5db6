"""Choices of strands by contact and pairing on customers and orders, and pair types on moved clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe import bindings as B
from molframe.functions.geom import snap
from molframe.operators import pair_types as P
from molframe.operators import selection as S
from molframe.registry.base import query, with_


def strand_tables(spark, sf):
    """Customers as strands, of which five in a row are paired one to the next; an order is a contact with the chain of its priority
    and day of the month."""
    o = B.table(spark, sf, "orders")
    contacts = o.select(F.lit(0).alias("entry"), F.concat("o_orderpriority", F.lit("/"), F.dayofmonth("o_orderdate").cast("string")).alias("chain"), F.col("o_custkey").alias("strand"))
    c = B.table(spark, sf, "customer").filter("c_custkey % 5 <> 0")
    pairs = c.select(F.lit(0).alias("entry"), F.col("c_custkey").alias("strand_a"), (F.col("c_custkey") + 1).alias("strand_b"))
    return contacts, pairs


@query("strands_touching", "B15", """WITH RECURSIVE p AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 5 <> 0),
two AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
kept(strand) AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND day(o_orderdate) IN (1, 2) UNION SELECT b FROM kept JOIN two ON a = strand)
SELECT strand FROM kept""")
def strands_touching(spark, sf):
    contacts, pairs = strand_tables(spark, sf)
    chosen = spark.createDataFrame([(0, "1-URGENT/1"), (0, "1-URGENT/2")], "entry int, chain string")
    return S.strands_touching(contacts, pairs, chosen).select("strand")


@query("touched_windows", "B16", """WITH RECURSIVE li AS (SELECT l_suppkey AS strand, date_diff('day', DATE '1990-01-01', l_shipdate::DATE)::INT AS pos, l_quantity, l_orderkey, l_linenumber FROM lineitem),
ends AS (SELECT strand, min(pos) AS lo, max(pos) AS hi FROM li GROUP BY strand),
w0 AS (SELECT strand, greatest(lo, min(pos) - 6) AS first, least(hi, max(pos) + 6) AS last FROM li JOIN ends USING (strand) WHERE l_quantity = 50 AND strand % 4 = 0 GROUP BY strand, lo, hi),
pr AS (SELECT a.strand, a.pos, b.strand AS to_, b.pos AS at_ FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND (a.l_linenumber = b.l_linenumber + 1 OR b.l_linenumber = a.l_linenumber + 1)),
w1 AS (SELECT strand, min(first) AS first, max(last) AS last FROM (SELECT * FROM w0 UNION ALL SELECT to_, min(at_), max(at_) FROM pr JOIN w0 w ON w.strand = pr.strand AND pos BETWEEN first AND last GROUP BY to_) GROUP BY strand),
w2 AS (SELECT strand, min(first) AS first, max(last) AS last FROM (SELECT * FROM w1 UNION ALL SELECT to_, min(at_), max(at_) FROM pr JOIN w1 w ON w.strand = pr.strand AND pos BETWEEN first AND last GROUP BY to_) GROUP BY strand),
w3 AS (SELECT strand, min(first) AS first, max(last) AS last FROM (SELECT * FROM w2 UNION ALL SELECT to_, min(at_), max(at_) FROM pr JOIN w2 w ON w.strand = pr.strand AND pos BETWEEN first AND last GROUP BY to_) GROUP BY strand)
SELECT strand, first, last, first - lo AS before, hi - last AS after FROM w3 JOIN ends USING (strand)""")
def touched_windows(spark, sf):
    """Suppliers as strands, ship days as places; lines that follow one another in an order are paired."""
    li = B.table(spark, sf, "lineitem").select(F.lit(0).alias("entry"), F.col("l_suppkey").alias("strand"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("pos"), "l_quantity", "l_orderkey", "l_linenumber")
    strands = li.groupBy("entry", "strand").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    side = lambda t, k: li.select("entry", F.col("strand").alias("strand" + t), F.col("pos").alias("pos" + t), "l_orderkey", (F.col("l_linenumber") + k).alias("line"))
    pairs = side("_a", 1).join(side("_b", 0), ["entry", "l_orderkey", "line"]).select("entry", "strand_a", "pos_a", "strand_b", "pos_b")
    w = S.touched_windows(li.filter("l_quantity = 50 and strand % 4 = 0"), strands, pairs)
    return S.crop_gaps(w, strands).drop("entry")


@query("pair_types", "D31", with_(B.PTS, "ent AS (SELECT chain AS acc, count(*) AS n, unnest(range(4)) AS k FROM pts GROUP BY chain)") + """
SELECT a.acc AS accession, a.k AS entry_a, b.k AS entry_b, CASE WHEN (a.k = 1) = (b.k = 1) AND a.n >= 30 AND (a.k = 2) = (b.k = 2) THEN 0.0 END AS rmsd,
    list_filter([CASE WHEN (a.k = 1) <> (b.k = 1) THEN 'apo/holo' END, CASE WHEN a.k = 0 AND b.k > 0 THEN 'monomer/oligomer' END,
        CASE WHEN (a.k = 1) = (b.k = 1) AND a.n >= 30 AND (a.k = 2) <> (b.k = 2) THEN 'open/closed' END], lambda x: x IS NOT NULL) AS types
FROM ent a JOIN ent b ON a.acc = b.acc AND a.k < b.k""")
def pair_types(spark, sf):
    """Four entries of the protein of every label: as it is, turned and with a ligand, bent, and shifted; all but the first in several copies."""
    p = B.points(spark, sf).select(F.col("chain").alias("accession"), F.col("idx").cast("int").alias("seq"), F.lit("").alias("icode"), "x", "y", "z").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    far = F.when((F.col("k") == 2) & (F.col("seq") % 2 == 0), 500.0).otherwise(0.0)
    at = {"x": F.when(F.col("k") == 1, -F.col("y")).otherwise(F.col("x")), "y": F.when(F.col("k") == 1, F.col("x")).otherwise(F.col("y")), "z": F.col("z") + F.col("k") * 7.0 + far}
    name = (F.col("accession") * 10 + F.col("k")).alias("entry")
    traces = p.select(name, "seq", "icode", *[v.alias(c) for c, v in at.items()])
    features = p.select(name, "accession", (F.col("k") == 1).alias("ligand_touching"), F.when(F.col("k") == 0, 1).otherwise(F.col("k") + 1).alias("assembly_chains")).distinct()
    t = P.pair_types(features, traces)
    digit = lambda c: F.pmod(F.col(c), F.lit(10)).alias(c)
    alike = (F.pmod("entry_a", F.lit(10)) == 2) == (F.pmod("entry_b", F.lit(10)) == 2)
    return t.select("accession", digit("entry_a"), digit("entry_b"), F.when(alike, snap(F.col("rmsd"), 100.0)).alias("rmsd"), "types")
