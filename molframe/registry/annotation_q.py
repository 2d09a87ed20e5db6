"""Annotation on residues, with offsets, clipping and overlaps that change the result."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from molframe import bindings as B
from molframe.functions import text as T
from molframe.operators import annotation as A
from molframe.registry.base import query, with_

RES = "res AS (SELECT DISTINCT chain, seq FROM pos)"
TRK = "trk AS (SELECT chain, min(seq) AS lo, max(seq) AS hi FROM pos GROUP BY chain)"


@query("domains_of_residues", "C22", with_(B.SEG, B.POS, RES) + """SELECT res.chain, seq, coalesce(max(domain), -1) AS domain, count(domain) > 1 AS several
FROM res LEFT JOIN seg ON seg.chain = res.chain AND seq BETWEEN first AND last GROUP BY res.chain, seq""")
def domains_of_residues(spark, sf):
    """The last listed domain of every residue; many orders overlap, so it is not the first."""
    r = B.positions(spark, sf).select("chain", "seq").distinct()
    s = B.segments(spark, sf)
    held = A.segments_to_residues(s, r, ["chain"])
    least = A.segments_to_residues(s.withColumn("domain", -F.col("domain")), r, ["chain"]).withColumnRenamed("domain", "_low")
    several = (F.col("domain") != -1) & (F.col("domain") != -F.col("_low"))
    return held.join(least, ["chain", "seq"]).select("chain", "seq", "domain", several.alias("several"))


@query("features_by_offset", "C23", with_(B.SEG, B.POS, RES, TRK, """mp AS (SELECT chain, lo AS s0, lo + (hi - lo) // 2 AS s1, lo + 20 - chain % 40 AS u0 FROM trk UNION ALL SELECT chain, lo + (hi - lo) // 2 + 30, hi, lo + (hi - lo) // 2 + 37 FROM trk)""") + """,
ft AS (SELECT m.chain, domain AS feature, CASE WHEN kind LIKE '1%' THEN 'DISULFID' ELSE 'REGION' END AS type, first + s0 - u0 AS b, last + s0 - u0 AS e, s0, s1 FROM seg JOIN mp m ON m.chain = seg.chain)
SELECT f.chain, feature, type, seq FROM ft f JOIN res r ON r.chain = f.chain AND seq BETWEEN greatest(b, s0) AND least(e, s1) WHERE type = 'REGION' OR seq IN (b, e)""")
def features_by_offset(spark, sf):
    """Two segments of every chain, each with an offset of its own between database and chain numbers."""
    s = B.segments(spark, sf)
    ft = s.select("chain", F.col("domain").alias("feature"), F.when(F.col("kind").startswith("1"), "DISULFID").otherwise("REGION").alias("type"), F.col("first").alias("begin"), F.col("last").alias("end"))
    r = B.positions(spark, sf).select("chain", "seq").distinct()
    t = r.groupBy("chain").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    mid = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
    part = lambda first, last, base: t.select("chain", first.alias("seq_first"), last.alias("seq_last"), base.alias("unp_first"))
    maps = part(F.col("lo"), mid, F.col("lo") + 20 - F.col("chain") % 40).unionByName(part(mid + 30, F.col("hi"), mid + 37))
    return A.features_to_residues(ft, maps, r, ["chain"]).select("chain", "feature", "type", "seq")


@query("clip_features", "E21", with_(B.SEG, B.POS, TRK) + """SELECT seg.chain, domain, greatest(first, lo + 40) AS "begin", least(last, hi - 40) AS "end" FROM seg JOIN trk USING (chain) WHERE greatest(first, lo + 40) <= least(last, hi - 40)""")
def clip_features(spark, sf):
    """Orders cut to the middle of their customer's track: some lose an end, some go."""
    s = B.segments(spark, sf).select("chain", "domain", F.col("first").alias("begin"), F.col("last").alias("end"))
    t = B.positions(spark, sf).groupBy("chain").agg((F.min("seq") + 40).alias("first"), (F.max("seq") - 40).alias("last"))
    return A.clip_features(s, t, ["chain"]).select("chain", "domain", "begin", "end")


@query("names_after_shift", "K6", with_(B.SEG) + """, k AS (SELECT domain, CASE status WHEN 'F' THEN 'α' ELSE 'β' END AS m, row_number() OVER w AS n, domain % 3 AS d, CASE WHEN domain % 5 = 0 THEN '''' ELSE '' END AS mark,
    count(*) FILTER (WHERE price < 200000) OVER (PARTITION BY chain, status ORDER BY domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sh FROM seg WINDOW w AS (PARTITION BY chain, status ORDER BY domain))
SELECT domain, m || n || mark = m || (n - sh + d) OR (mark = '' AND d = 0) AS same FROM k""")
def names_after_shift(spark, sf):
    """Numbered names against ones whose number is off by 0, 1 or 2 once the shift is taken off; every fifth carries a mark."""
    s = B.segments(spark, sf).withColumn("m", F.when(F.col("status") == "F", "α").otherwise("β"))
    w = Window.partitionBy("chain", "status").orderBy("domain")
    s = s.withColumn("n", F.row_number().over(w)).withColumn("sh", F.count_if(F.col("price") < 200000).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    a = F.concat("m", "n", F.when(F.col("domain") % 5 == 0, "'").otherwise(""))
    b = F.concat("m", F.col("n") - F.col("sh") + F.col("domain") % 3)
    return s.select("domain", T.same_name(a, b, F.col("sh"), F.lit(0)).alias("same"))
