"""Queries on the segment binding: orders as domain segments, shipments as residues."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe import bindings as B
from molframe.functions import text as T
from molframe.functions.geom import snap
from molframe.operators import compare as K
from molframe.operators import nucleic as N
from molframe.operators import sampling as P
from molframe.operators import campaign as C
from molframe.operators.backbone import labels
from molframe.operators.userdata import join_user_values
from molframe.operators import annotation as A
from molframe.plans import intervals as I
from molframe.registry.base import query, with_
from molframe.registry.points_q import rsnap


@query("points_in_segments", "C22", with_(B.SEG, B.POS) + """ SELECT p.chain, p.ord, p.line, count(s.domain) AS domains, coalesce(min(s.domain), -1) AS domain FROM pos p LEFT JOIN seg s ON s.chain = p.chain AND p.seq BETWEEN s.first AND s.last GROUP BY ALL""")
def in_segments(spark, sf):
    s = B.segments(spark, sf).select("chain", "domain", "first", "last")
    j = I.points_in(B.positions(spark, sf), s, ["chain"], "seq", "first", "last", how="left")
    return j.groupBy("chain", "ord", "line").agg(F.count("domain").alias("domains"), F.coalesce(F.min("domain"), F.lit(-1)).alias("domain"))


@query("spans_meeting", "C25", with_(B.SEG) + """ SELECT a.chain, a.domain AS domain_a, b.domain AS domain_b, (least(a.last, b.last) - greatest(a.first, b.first) + 1)::INT AS shared FROM seg a JOIN seg b ON a.chain = b.chain AND a.domain < b.domain
 WHERE least(a.last, b.last) >= greatest(a.first, b.first)""")
def meeting(spark, sf):
    s = B.segments(spark, sf).select("chain", "domain", "first", "last")
    return I.spans_meeting(s, s, ["chain"], "first", "last").filter("domain_a < domain_b").select("chain", "domain_a", "domain_b", "shared")


GREEDY = """xs AS (SELECT * FROM seg WHERE price < 250000), ys AS (SELECT * FROM seg WHERE price >= 250000),
cand AS (SELECT a.chain, a.domain AS ida, b.domain AS idb, least(a.last, b.last) - greatest(a.first, b.first) + 1 AS shared, a.first AS fa, b.first AS fb FROM xs a JOIN ys b ON a.chain = b.chain AND a.status = b.status
  WHERE 2 * (least(a.last, b.last) - greatest(a.first, b.first) + 1) >= 31),
rk AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY shared DESC, fa, ida, fb, idb) AS k FROM cand),
st AS (SELECT DISTINCT chain, 0::BIGINT AS k, []::BIGINT[] AS ua, []::BIGINT[] AS ub FROM rk UNION ALL
 SELECT s.chain, s.k + 1, CASE WHEN list_contains(ua, r.ida) OR list_contains(ub, r.idb) THEN ua ELSE list_append(ua, r.ida) END,
  CASE WHEN list_contains(ua, r.ida) OR list_contains(ub, r.idb) THEN ub ELSE list_append(ub, r.idb) END FROM st s JOIN rk r ON r.chain = s.chain AND r.k = s.k + 1),
fin AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY chain ORDER BY k DESC) = 1)"""


@query("pair_places", "C25", with_(B.SEG, GREEDY) + " SELECT chain, unnest(ua) AS a, unnest(ub) AS b FROM fin")
def places(spark, sf):
    s = B.segments(spark, sf).select("chain", F.col("status").alias("kind"), F.col("domain").alias("id"), "first", "last", "price")
    p = K.pair_places(s.filter("price < 250000").drop("price"), s.filter("price >= 250000").drop("price"), ["chain"])
    return p.select("chain", F.col("id_a").alias("a"), F.col("id_b").alias("b"))


KNOT = """rk AS (SELECT chain, domain, first AS i, last AS j, row_number() OVER (PARTITION BY chain ORDER BY price DESC, domain) AS k FROM seg),
st AS (SELECT DISTINCT chain, 0::BIGINT AS k, []::STRUCT(i INT, j INT, d BIGINT, l INT)[] AS kept FROM rk UNION ALL
 SELECT s.chain, s.k + 1, list_append(kept, {'i': r.i, 'j': r.j, 'd': r.domain, 'l': %s}) FROM st s JOIN rk r ON r.chain = s.chain AND r.k = s.k + 1),
fin AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY chain ORDER BY k DESC) = 1)"""
CROSS = "((x.i < r.i AND r.i < x.j AND x.j < r.j) OR (r.i < x.i AND x.i < r.j AND r.j < x.j))"
KEPT = KNOT % f"CASE WHEN len(list_filter(kept, lambda x: x.l = 0 AND {CROSS})) > 0 THEN 1 ELSE 0 END"
LEVEL = KNOT % f"list_min(list_filter(range(0, 60), lambda v: len(list_filter(kept, lambda x: x.l = v AND {CROSS})) = 0))::INT"


def knot_pairs(spark, sf):
    s = B.segments(spark, sf)
    return s.select("chain", "domain", F.col("first").alias("i"), F.col("last").alias("j"), (-F.col("price")).alias("rank"), F.col("domain").alias("tie"))


@query("pseudoknots", "H7", with_(B.SEG, KEPT) + " SELECT chain, x.d AS domain, x.l = 0 AS kept FROM (SELECT chain, unnest(kept) AS x FROM fin)")
def knots(spark, sf):
    return N.pseudoknots(knot_pairs(spark, sf), ["chain"], "domain", ["rank", "tie"])


@query("pair_levels", "H7", with_(B.SEG, LEVEL) + " SELECT chain, x.d AS domain, x.l AS level FROM (SELECT chain, unnest(kept) AS x FROM fin)")
def levels(spark, sf):
    return N.pair_levels(knot_pairs(spark, sf), ["chain"], "domain", ["rank", "tie"])


@query("stoichiometry", "D3", with_(B.SEG) + """, n AS (SELECT chain, kind, count(*) AS n FROM seg GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY n DESC, kind) AS k FROM n)
SELECT chain, string_agg(chr(64 + k::INT) || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END, '' ORDER BY k) AS formula, count(*) AS groups FROM r GROUP BY chain""")
def stoichiometry(spark, sf):
    return C.stoichiometry(B.segments(spark, sf), ["chain"], "kind")


@query("elements_in_segments", "C39", with_(B.SEG, B.POS) + """, h AS (SELECT p.chain, p.ord, s.domain, count(*) AS held FROM pos p JOIN seg s ON s.chain = p.chain AND p.seq BETWEEN s.first AND s.last GROUP BY ALL), n AS (SELECT chain, ord, count(*) AS size FROM pos GROUP BY ALL)
SELECT chain, ord, domain, held, size FROM h JOIN n USING (chain, ord) WHERE held * 2 > size""")
def elements(spark, sf):
    p = B.positions(spark, sf).withColumnRenamed("ord", "element")
    s = B.segments(spark, sf).select("chain", "domain", "first", "last")
    return A.elements_in_segments(p, s, ["chain"]).withColumnRenamed("element", "ord")


@query("features_to_residues", "C23 E21", with_(B.SEG, B.POS) + """, ft AS (SELECT chain, domain AS feature, CASE WHEN kind LIKE '1%' THEN 'DISULFID' ELSE 'REGION' END AS type, first AS b, last AS e FROM seg),
m AS (SELECT chain, min(seq) - 5 AS off FROM pos GROUP BY chain), r AS (SELECT DISTINCT chain, seq FROM pos)
SELECT f.chain, f.feature, f.type, r.seq FROM ft f JOIN m USING (chain) JOIN r ON r.chain = f.chain AND r.seq BETWEEN f.b + m.off - m.off AND f.e + m.off - m.off WHERE f.type = 'REGION' OR r.seq IN (f.b, f.e)""")
def features(spark, sf):
    s = B.segments(spark, sf)
    ft = s.select("chain", F.col("domain").alias("feature"), F.when(F.col("kind").startswith("1"), "DISULFID").otherwise("REGION").alias("type"), F.col("first").alias("begin"), F.col("last").alias("end"))
    r = B.positions(spark, sf).select("chain", "seq").distinct()
    maps = r.groupBy("chain").agg((F.min("seq") - 5).alias("seq_first"), F.max("seq").alias("seq_last")).withColumn("unp_first", F.col("seq_first"))
    return A.features_to_residues(ft, maps, r, ["chain"]).select("chain", "feature", "type", "seq")


@query("join_user_values", "C21 K1", with_(B.SEG, B.POS) + """, res AS (SELECT 'C' || chain AS chain, seq // 30 AS seq, min(name) AS name FROM pos GROUP BY ALL),
raw AS (SELECT domain AS row, 'C' || chain AS chain, first // 30 AS seq, CASE status WHEN 'P' THEN '' WHEN 'F' THEN 'A' ELSE status END AS nm,
  CASE WHEN kind LIKE '1%' THEN 'inf' WHEN kind LIKE '2%' THEN '' ELSE price::VARCHAR END AS v FROM seg),
j AS (SELECT r.*, res.name AS name, (SELECT count(*) FROM res x WHERE x.chain = r.chain) AS inchain FROM raw r LEFT JOIN res ON res.chain = r.chain AND res.seq = r.seq),
w AS (SELECT *, CASE WHEN inchain = 0 THEN 'no chain' WHEN name IS NULL THEN 'no residue' WHEN nm <> '' AND nm <> name THEN 'name differs' END AS why, v = 'inf' AS bad FROM j),
f AS (SELECT chain, seq, min(row) AS first_row FROM w WHERE why IS NULL AND NOT bad GROUP BY ALL)
SELECT w.row, coalesce(why, CASE WHEN w.row > first_row THEN 'given twice' END, CASE WHEN bad THEN 'not finite' END, 'used') AS reason FROM w LEFT JOIN f ON f.chain = w.chain AND f.seq = w.seq""")
def user_values(spark, sf):
    e = F.lit(0).alias("entry")
    res = B.positions(spark, sf).groupBy(F.concat(F.lit("C"), F.col("chain")).alias("chain"), F.floor(F.col("seq") / 30).cast("int").alias("seq")).agg(F.min("name").alias("one"))
    res = res.select(e, "chain", "seq", F.lit("").alias("icode"), F.when(F.col("one") == "A", "ALA").when(F.col("one") == "N", "ASN").otherwise("ARG").alias("resname"))
    s = B.segments(spark, sf)
    name = F.when(F.col("status") == "P", "").when(F.col("status") == "F", "A").otherwise(F.col("status"))
    cell = F.when(F.col("kind").startswith("1"), F.lit("inf")).when(F.col("kind").startswith("2"), F.lit("")).otherwise(F.col("price").cast("string"))
    rows = s.select(e, F.col("domain").alias("row"), F.concat(F.lit("C"), F.col("chain")).alias("chain"), F.floor(F.col("first") / 30).cast("string").alias("residue"),
                    F.lit("").alias("icode"), name.alias("resname"), cell.alias("value"))
    out = join_user_values(rows, res)
    return out.select("row", F.coalesce("reason", F.lit("used")).alias("reason"))


@query("generic_labels", "E14 K5", with_(B.SEG) + """, k AS (SELECT *, CASE status WHEN 'F' THEN 'E' WHEN 'O' THEN 'H' ELSE 'G' END AS k, row_number() OVER (PARTITION BY chain, status ORDER BY domain) - 1 AS n FROM seg)
SELECT chain, domain, CASE WHEN k = 'E' THEN CASE WHEN n < 26 THEN chr((65 + n)::INT) ELSE 'S' || (n + 1) END WHEN k = 'G' THEN 'η' || (n + 1) ELSE 'α' || (n + 1) END AS label FROM k""")
def generic(spark, sf):
    kind = F.when(F.col("status") == "F", "E").when(F.col("status") == "O", "H").otherwise("G")
    s = B.segments(spark, sf).withColumn("entry", F.lit(0)).withColumn("kind", kind)
    return labels(s, "domain").select("chain", "domain", "label")


@query("residue_order", "F2 K1", """WITH t AS (SELECT o_orderkey AS k, (o_orderkey % 211 - 40)::VARCHAR || substr(o_orderstatus, 1, (o_orderkey % 2)::INT) AS tag, o_orderpriority AS chain FROM orders)
SELECT k, regexp_extract(tag, '^(-?[0-9]+)([A-Za-z]?)$', 1)::INT AS number, regexp_extract(tag, '^(-?[0-9]+)([A-Za-z]?)$', 2) AS icode,
 row_number() OVER (PARTITION BY chain ORDER BY regexp_extract(tag, '^(-?[0-9]+)([A-Za-z]?)$', 1)::INT, regexp_extract(tag, '^(-?[0-9]+)([A-Za-z]?)$', 2), k) AS place FROM t""")
def order(spark, sf):
    from molframe.plans.ordered import Ordered

    k = F.col("o_orderkey")
    ic = F.when(k % 2 == 1, F.substring("o_orderstatus", 1, 1)).otherwise(F.lit(""))
    t = B.table(spark, sf, "orders").select(k.alias("k"), F.concat((k % 211 - 40).cast("string"), ic).alias("tag"), F.col("o_orderpriority").alias("chain"))
    t = t.withColumn("number", T.residue_number(F.col("tag"))).withColumn("icode", T.residue_icode(F.col("tag")))
    # author numbers repeat, so the number itself is the block
    return Ordered(t, ["chain"], ["number", "icode", "k"], F.col("number").cast("bigint")).row_number("place").done().select("k", "number", "icode", "place")


@query("best_structures", "F3", with_(B.SEG) + """ SELECT chain, domain, row_number() OVER (PARTITION BY chain ORDER BY floor(price / 50000) DESC, coalesce(CASE WHEN status = 'P' THEN NULL ELSE price % 10 END, 99), domain)::INT AS rank FROM seg""")
def best(spark, sf):
    s = B.segments(spark, sf).withColumn("coverage", F.floor(F.col("price") / 50000)).withColumn("resolution", F.when(F.col("status") != "P", F.col("price") % 10))
    return A.best_structures(s, ["chain"], "coverage", "resolution", "domain").select("chain", "domain", "rank")


@query("release_window", "B14", """SELECT o_orderkey AS k FROM orders WHERE o_orderdate::DATE > DATE '1996-03-31' AND o_orderdate::DATE <= DATE '1997-06-30'""")
def released(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"))
    return o.filter(P.release_window(F.col("d"), "1996-03-31", "1997-06-30")).select("k")


@query("segment_coverage", "D39", with_(B.SEG) + f""", c AS (SELECT chain, greatest(0, least(last, first - first % 100 + 60) - greatest(first, first - first % 100 + 10)) / (last - first)::DOUBLE AS share FROM seg)
SELECT chain, count(*) AS segments, {rsnap('avg(share)', 1000000)} AS mean FROM c GROUP BY chain""")
def coverage(spark, sf):
    s = B.segments(spark, sf)
    base = F.col("first") - F.col("first") % 100
    d = s.select("chain", F.col("first").alias("lo"), F.col("last").alias("hi"), (base + 10).alias("slab_lo"), (base + 60).alias("slab_hi"))
    g = A.segment_coverage(d, ["chain"])
    return g.select("chain", "segments", snap(F.col("mean"), 1e6).alias("mean"))


@query("range_predicate", "B8", with_(B.SEG) + " SELECT chain, domain FROM seg WHERE chain = 7 AND first BETWEEN 2000 AND 2600")
def in_range(spark, sf):
    s = B.segments(spark, sf).withColumn("seq", F.col("first")).withColumn("icode", F.lit(""))
    return s.filter(A.range_predicate("res:7:2000-2600", F.col("chain").cast("string"))).select("chain", "domain")


@query("normalise_header", "K10", """SELECT n_nationkey, lower(regexp_replace(' ' || n_name || '.A-b ', '[ _.\\-]', '', 'g')) AS header FROM nation""")
def header(spark, sf):
    n = B.table(spark, sf, "nation")
    return n.select("n_nationkey", T.normalise_header(F.concat(F.lit(" "), F.col("n_name"), F.lit(".A-b "))).alias("header"))


@query("letters", "K5", """WITH RECURSIVE k(n, rest, t) AS (SELECT o_orderkey, o_orderkey, '' FROM orders UNION ALL SELECT n, rest // 26 - 1, chr((65 + rest % 26)::INT) || t FROM k WHERE rest >= 0)
SELECT n, t AS letters FROM k WHERE rest < 0""")
def letters(spark, sf):
    return B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), T.letters(F.col("o_orderkey")).alias("letters"))


@query("same_name", "K6", with_(B.SEG) + """, k AS (SELECT chain, domain, CASE status WHEN 'F' THEN 'α' ELSE 'β' END AS m, row_number() OVER w AS n, count(*) FILTER (WHERE price < 200000) OVER (PARTITION BY chain, status ORDER BY domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sh FROM seg WINDOW w AS (PARTITION BY chain, status ORDER BY domain))
SELECT domain, (m || n = m || (n - sh)) OR (n - sh = n - sh - 0) AS same, (m || n = 'α3') OR (m = 'α' AND n - sh = 3) AS third FROM k""")
def names(spark, sf):
    from pyspark.sql import Window

    s = B.segments(spark, sf).withColumn("m", F.when(F.col("status") == "F", "α").otherwise("β"))
    w = Window.partitionBy("chain", "status").orderBy("domain")
    s = s.withColumn("n", F.row_number().over(w)).withColumn("sh", F.count_if(F.col("price") < 200000).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    a, b = F.concat("m", "n"), F.concat(F.col("m"), F.col("n") - F.col("sh"))
    return s.select("domain", T.same_name(a, b, F.col("sh"), F.lit(0)).alias("same"), T.same_name(a, F.lit("α3"), F.col("sh"), F.lit(0)).alias("third"))


@query("one_protein", "D35", with_(B.POS) + """, g AS (SELECT chain, count(*) AS aligned, count(*) FILTER (WHERE name = 'N') AS identical, count(DISTINCT seq) AS shorter FROM pos GROUP BY chain)
SELECT chain, aligned, identical, identical >= 0.9 * aligned AND identical * 2 >= shorter AS one_protein FROM g""")
def one(spark, sf):
    from molframe.operators.msa import one_protein

    p = B.positions(spark, sf)
    n = p.groupBy("chain").agg(F.countDistinct("seq").alias("shorter"))
    return one_protein(p.join(n, "chain").withColumn("other", F.lit("N")), ["chain"], "name", "other", "shorter")
