"""Queries on the point binding: distance joins, superposition sums, slabs, boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe import bindings as B
from molframe.functions import geom as G
from molframe.operators import contacts as C
from molframe.plans import spatial as S
from molframe.plans.ranks import quantiles
from molframe.registry.atoms_q import DIST
from molframe.registry.base import query, with_


def rsnap(e: str, g: int = 1000) -> str:
    return f"(floor(({e}) * {g} + 0.5) / {g} + 0.0)"


@query("pairs_within", "C1", with_(B.PTS) + f" SELECT a.idx AS idx_a, b.idx AS idx_b, {DIST} AS distance FROM pts a JOIN pts b ON a.entry = b.entry AND a.idx < b.idx AND {DIST} <= 8.0")
def pairs_within(spark, sf):
    return S.pairs_within(B.points(spark, sf).select("entry", "idx", "x", "y", "z"), 8.0).select("idx_a", "idx_b", "distance")


@query("pairs_between", "C2", with_(B.PTS) + f" SELECT a.idx AS idx_a, b.idx AS idx_b, {DIST} AS distance FROM pts a JOIN pts b ON a.entry = b.entry AND a.chain < 5 AND b.chain >= 5 AND {DIST} <= 4.0")
def pairs_between(spark, sf):
    p = B.points(spark, sf)
    return S.pairs_between(p.filter("chain < 5"), p.filter("chain >= 5"), 4.0).select("idx_a", "idx_b", "distance")


@query("element_contacts", "D1", with_(B.PTS) + f""" SELECT least(a.element, b.element) AS element_a, greatest(a.element, b.element) AS element_b, count(*) AS ca_pairs
FROM pts a JOIN pts b ON a.entry = b.entry AND a.idx < b.idx AND a.element <> b.element AND {DIST} <= 8.0 GROUP BY ALL HAVING count(*) >= 3""")
def element_contacts(spark, sf):
    return C.element_contacts(B.points(spark, sf)).drop("entry")


@query("label_ncut", "D12", with_(B.PTS) + f""", c AS (SELECT a.chain AS la, b.chain AS lb FROM pts a JOIN pts b ON a.entry = b.entry AND b.idx - a.idx >= 6 AND {DIST} <= 12.0),
e AS (SELECT la AS label, la <> lb AS x FROM c UNION ALL SELECT lb, la <> lb FROM c),
p AS (SELECT label, count(*) AS degree, count(*) FILTER (WHERE x) AS cut FROM e GROUP BY label)
SELECT label, cut, degree, {rsnap('cut::DOUBLE / degree + cut::DOUBLE / nullif((SELECT sum(degree) FROM p)::BIGINT - degree, 0)')} AS ncut FROM p""")
def label_ncut(spark, sf):
    p = B.points(spark, sf).withColumnRenamed("chain", "label")
    return C.label_ncut(p).select("label", "cut", "degree", G.snap(F.col("ncut")).alias("ncut"))


@query("top_k_per_key", "F1", with_(B.PTS) + f""", n AS (SELECT a.idx AS donor, b.idx AS acceptor, {DIST} AS distance FROM pts a JOIN pts b ON a.entry = b.entry AND a.idx <> b.idx AND {DIST} <= 9.0)
SELECT donor, acceptor, distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY donor ORDER BY distance, acceptor) AS rank FROM n) WHERE rank <= 2""")
def top_k(spark, sf):
    p = B.points(spark, sf).select("entry", "idx", "x", "y", "z")
    n = S.nearest_k(p, 9.0, 2)
    return n.select(F.col("idx_a").alias("donor"), F.col("idx_b").alias("acceptor"), "distance", "rank")


XY = [(u, v) for u in "xyz" for v in "uvw"]


@query("kabsch_sums", "D10", with_(B.PTS, B.MOVED) + " SELECT chain, count(*) AS n, " + ", ".join(f"{rsnap(f'sum({c})')} AS s_{c}" for c in "xyzuvw")
       + ", " + ", ".join(f"{rsnap(f'sum({a} * {b})')} AS s_{a}{b}" for a, b in XY) + " FROM moved GROUP BY chain")
def kabsch_sums(spark, sf):
    from molframe.operators.superpose import fit_sums

    s = fit_sums(B.moved_points(spark, sf), ["chain"])
    return s.select("chain", "n", *[G.snap(F.col(c)).alias(c) for c in s.columns if c.startswith("s_") and c not in ("s_aa", "s_bb")])


@query("kabsch", "D10 J1")
def kabsch(spark, sf):
    from molframe.operators.superpose import kabsch as fit

    f = fit(B.moved_points(spark, sf), ["chain"])
    scr = G.screw(F.col("r"), G.vec("t"))
    return f.select("chain", "n", G.snap(F.col("rmsd")).alias("rmsd"), G.snap(scr["angle"]).alias("angle"), G.snap(scr["rise"]).alias("rise"))


@query("tm_terms", "D11 K12", with_(B.PTS, B.MOVED) + f""", m AS (SELECT chain, {rsnap('sqrt((x - u) * (x - u) + (y - v) * (y - v) + (z - w) * (z - w))', 1024)} AS d, count(*) OVER (PARTITION BY chain) AS l FROM moved),
k AS (SELECT *, greatest(0.5, 1.24 * cbrt(greatest(l::DOUBLE - 15.0, 0.0)) - 1.8) AS s FROM m)
SELECT chain, l AS length, {rsnap('sum(1.0 / (1.0 + (d / s) * (d / s))) / l')} AS tm FROM k GROUP BY chain, l""")
def tm_terms(spark, sf):
    m = B.moved_points(spark, sf)
    n = m.groupBy("chain").agg(F.count(F.lit(1)).alias("length"))
    d = G.dist(G.vec_cols(), G.vec_cols("u", "v", "w"))
    t = m.join(n, "chain").withColumn("t", G.tm_term(d, G.d0(F.col("length"))))
    return t.groupBy("chain", "length").agg(G.snap(F.sum("t") / F.first("length")).alias("tm"))


@query("vectors", "K3 K4 K12", with_(B.PTS, B.MOVED) + f""", k AS (SELECT idx, x * u + y * v + z * w AS dot, sqrt(x * x + y * y + z * z) * sqrt(u * u + v * v + w * w) AS nn,
 y * w - z * v AS cx, z * u - x * w AS cy, x * v - y * u AS cz, (x + y) * 20 AS t FROM moved)
SELECT idx, {rsnap('dot')} AS dot, {rsnap('degrees(acos(least(1.0, greatest(-1.0, dot / nullif(nn, 0.0)))))')} AS angle,
 {rsnap('cx')} AS cross_x, {rsnap('cy')} AS cross_y, {rsnap('cz')} AS cross_z,
 CASE WHEN {rsnap('t - 360.0 * ceil((t - 180.0) / 360.0)')} = -180.0 THEN 180.0 ELSE {rsnap('t - 360.0 * ceil((t - 180.0) / 360.0)')} END AS wrapped FROM k""")
def vectors(spark, sf):
    m = B.moved_points(spark, sf)
    a, b = G.vec_cols(), G.vec_cols("u", "v", "w")
    c = a.cross(b)
    return m.select(
        "idx", G.snap(a.dot(b)).alias("dot"), G.snap(G.vec_angle(a, b)).alias("angle"),
        *[G.snap(v).alias("cross_" + n) for n, v in zip("xyz", c)], G.angle_deg((F.col("x") + F.col("y")) * 20).alias("wrapped"),
    )


@query("crosslink_lengths", "C20", with_(B.PTS) + f""" SELECT e.vec_id AS a, e.vec_id + 7 AS b, {DIST} AS distance, {DIST} > 30.0 AS over_span
FROM embeddings e JOIN pts a ON a.idx = e.vec_id JOIN pts b ON b.idx = e.vec_id + 7""")
def crosslinks(spark, sf):
    from molframe.operators.userdata import crosslink_lengths

    p = B.points(spark, sf).select("entry", F.lit("A").alias("chain"), F.col("idx").alias("seq"), F.lit("").alias("icode"), "x", "y", "z")
    links = p.select("entry", *[F.col(c).alias("a_" + c) for c in ("chain", "seq", "icode")],
                     F.col("chain").alias("b_chain"), (F.col("seq") + 7).alias("b_seq"), F.col("icode").alias("b_icode"),
                     F.lit(None).cast("double").alias("span"))
    out = crosslink_lengths(links, p).filter("distance is not null")
    return out.select(F.col("a_seq").alias("a"), F.col("b_seq").alias("b"), "distance", "over_span")


BOX = "box AS (SELECT entry, idx, x - 1.5 AS x0, x + 1.5 AS x1, y - 1.0 AS y0, y + 1.0 AS y1 FROM pts)"


@query("box_overlaps", "C33", with_(B.PTS, BOX) + f""" SELECT a.idx AS idx_a, b.idx AS idx_b, {rsnap('least(a.x1, b.x1) - greatest(a.x0, b.x0)')} AS dx,
 {rsnap('least(a.y1, b.y1) - greatest(a.y0, b.y0)')} AS dy FROM box a JOIN box b ON a.entry = b.entry AND a.idx < b.idx
 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.25 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.25""")
def boxes(spark, sf):
    p = B.points(spark, sf)
    c = F.col
    box = p.select("entry", "idx", (c("x") - 1.5).alias("x0"), (c("x") + 1.5).alias("x1"), (c("y") - 1.0).alias("y0"), (c("y") + 1.0).alias("y1"))
    return S.boxes_meeting(box, 4.0, 0.25).select("idx_a", "idx_b", G.snap(c("dx")).alias("dx"), G.snap(c("dy")).alias("dy"))


def _side(p, q, r):
    return f"(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"


SEGS = """sg AS (SELECT idx, chain AS line, x AS px, y AS py, u AS qx, v AS qy FROM moved)"""


@query("segment_crossings", "C34", with_(B.PTS, B.MOVED, SEGS) + f""" SELECT a.idx AS idx_a, b.idx AS idx_b FROM sg a JOIN sg b ON a.idx < b.idx AND a.line <> b.line
 AND {_side('a.p', 'a.q', 'b.p')} * {_side('a.p', 'a.q', 'b.q')} < 0 AND {_side('b.p', 'b.q', 'a.p')} * {_side('b.p', 'b.q', 'a.q')} < 0""")
def crossings(spark, sf):
    c = F.col
    s = B.moved_points(spark, sf).select("entry", "idx", c("chain").alias("line"), c("x").alias("px"), c("y").alias("py"), c("u").alias("qx"), c("v").alias("qy"))
    return S.segment_crossings(s, 4.0).select("idx_a", "idx_b")


@query("place_deviation", "D32", with_(B.PTS, B.MOVED) + f""", m AS (SELECT chain, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM moved GROUP BY chain),
c AS (SELECT chain, x - mx AS ax, y - my AS ay, u - mu AS bx, v - mv AS by_ FROM moved JOIN m USING (chain)),
t AS (SELECT chain, atan2(sum(ax * by_ - ay * bx), sum(ax * bx + ay * by_)) AS th FROM c GROUP BY chain),
d AS (SELECT chain, {rsnap('sqrt((cos(th) * ax - sin(th) * ay - bx) * (cos(th) * ax - sin(th) * ay - bx) + (sin(th) * ax + cos(th) * ay - by_) * (sin(th) * ax + cos(th) * ay - by_))')} AS dev FROM c JOIN t USING (chain))
SELECT chain, count(*) AS n, {rsnap('quantile_cont(dev, 0.5)', 1000000)} AS median, {rsnap('quantile_cont(dev, 0.9)', 1000000)} AS p90, max(dev) AS largest FROM d GROUP BY chain""")
def place_deviation(spark, sf):
    from molframe.operators.superpose import planar_deviation

    return planar_deviation(B.moved_points(spark, sf), ["chain"])


@query("relation_share", "D33", with_(B.PTS, B.MOVED) + f""", s AS (SELECT a.chain, (sign(a.x - b.x) = sign(a.u - b.u) AND sign(a.y - b.y) = sign(a.v - b.v)) AS same
 FROM moved a JOIN moved b ON a.entry = b.entry AND a.chain = b.chain AND a.element = b.element AND a.idx < b.idx)
SELECT chain, count(*) AS pairs, {rsnap('count(*) FILTER (WHERE same) / count(*)::DOUBLE')} AS share FROM s GROUP BY chain""")
def relation_share(spark, sf):
    from molframe.operators.superpose import relation_share as share

    return share(B.moved_points(spark, sf), ["entry", "chain", "element"]).groupBy("chain").agg(
        F.sum("pairs").alias("pairs"), G.snap(F.sum("same") / F.sum("pairs").cast("double")).alias("share")
    )


@query("membrane_measures", "D34", with_(B.PTS) + f""", d AS (SELECT element, idx, {rsnap('x * 0.6 + y * 0.0 + z * 0.8 - 0.0')} AS dep FROM pts),
m AS (SELECT element, min(dep) AS lo, max(dep) AS hi, {rsnap('avg(dep)')} AS mid, arg_min(dep, idx) AS a, arg_max(dep, idx) AS b, count(*) AS n FROM d GROUP BY element),
k AS (SELECT *, n >= 2 AND lo < 0 AND hi > 0 AND {rsnap('hi - lo')} >= 10.0 AS c FROM m)
SELECT element, lo AS depth_min, hi AS depth_max, n >= 2 AND lo <= -8.0 AND hi >= 8.0 AS spans_slab, c AS crosses_midplane,
 CASE WHEN c THEN 'across' WHEN mid >= 10.0 THEN 'out' WHEN mid <= -10.0 THEN 'in' ELSE 'slab' END AS side,
 CASE WHEN a >= 0 THEN 'out' ELSE 'in' END AS side_from, CASE WHEN b >= 0 THEN 'out' ELSE 'in' END AS side_to FROM k""")
def membrane_measures(spark, sf):
    from molframe.operators.membrane import element_depths

    return element_depths(B.points(spark, sf), G.lit_vec(0.6, 0.0, 0.8), F.lit(0.0), F.lit(10.0)).drop("entry")


SLAB = f"""names(i, oily, polar) AS (VALUES (0, true, false), (1, false, true), (2, true, false), (3, false, false)),
r AS (SELECT chain, {rsnap('z')} AS dep, n.oily, n.polar FROM pts JOIN names n ON n.i = idx % 4),
c AS (SELECT chain, unnest(range(floor(dep - 15.0)::BIGINT + 1, ceil(dep + 15.0)::BIGINT)) AS centre, oily, polar FROM r),
s AS (SELECT chain, centre, count(*) AS residues, count(*) FILTER (WHERE oily) AS n_oily, count(*) FILTER (WHERE polar) AS n_polar FROM c GROUP BY ALL HAVING count(*) >= 20)"""


@query("membrane_slab", "J12", with_(B.PTS, SLAB) + f""" SELECT chain, centre::BIGINT AS centre, residues, {rsnap('oily')} AS oily, {rsnap('polar')} AS polar FROM
 (SELECT chain, centre, residues, n_oily::DOUBLE / residues AS oily, n_polar::DOUBLE / residues AS polar,
  row_number() OVER (PARTITION BY chain ORDER BY n_oily - 1.5 * n_polar DESC, centre) AS rn FROM s) WHERE rn = 1""")
def slab(spark, sf):
    from molframe.operators.membrane import best_slab

    p = B.points(spark, sf)
    k = F.pmod("idx", F.lit(4))
    r = p.select("chain", G.snap(F.col("z")).alias("depth"), k.isin(0, 2).alias("is_oily"), (k == 1).alias("is_polar"))
    s = best_slab(r, ["chain"])
    return s.select("chain", "centre", "residues", G.snap(F.col("oily")).alias("oily"), G.snap(F.col("polar")).alias("polar"))


@query("membrane_class", "D40", with_(B.PTS) + f""", d AS (SELECT element, z - 0.0 AS dep FROM pts),
m AS (SELECT element, min(dep) AS lo, max(dep) AS hi, {rsnap('avg(dep)')} AS mid, quantile_cont(dep, 0.5) AS med, count(*) AS n FROM d GROUP BY element),
k AS (SELECT *, n >= 2 AND lo < 0 AND hi > 0 AND {rsnap('hi - lo')} >= 10.0 AS c FROM m)
SELECT element, c AS crosses, NOT c AND abs(med) < 10.0 AS in_slab, {rsnap('abs(abs(mid) - 10.0)')} <= 7.5 AS at_face,
 CASE WHEN mid >= 0 THEN 'out' ELSE 'in' END AS side, CASE WHEN mid >= 0 THEN lo ELSE -hi END AS bound FROM k""")
def classes(spark, sf):
    from molframe.operators.membrane import element_class

    out = element_class(B.points(spark, sf), G.lit_vec(0.0, 0.0, 1.0), F.lit(0.0), F.lit(10.0))
    return out.select("element", "crosses", "in_slab", "at_face", "side", "bound")


@query("distance_quartiles", "D20 C1", with_(B.PTS) + f""", p AS (SELECT a.chain, {DIST} AS d FROM pts a JOIN pts b ON a.entry = b.entry AND a.idx < b.idx AND {DIST} <= 8.0)
SELECT chain, count(*) AS n, {rsnap('quantile_cont(d, 0.25)', 1000000)} AS q1, {rsnap('quantile_cont(d, 0.5)', 1000000)} AS median, {rsnap('quantile_cont(d, 0.75)', 1000000)} AS q3 FROM p GROUP BY chain""")
def quarts(spark, sf):
    p = S.pairs_within(B.points(spark, sf).select("entry", "chain", "idx", "x", "y", "z"), 8.0)
    q = quantiles(p.withColumnRenamed("chain_a", "chain"), ["chain"], "distance", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return q.select("chain", "n", *[G.snap(F.col(c), 1e6).alias(c) for c in ("q1", "median", "q3")])


@query("snap", "B11", with_(B.PTS) + f" SELECT idx, {rsnap('x / 7.0')} AS x, {rsnap('y / 7.0', 1024)} AS y FROM pts")
def snapped(spark, sf):
    p = B.points(spark, sf)
    return p.select("idx", G.snap(F.col("x") / 7.0).alias("x"), G.snap(F.col("y") / 7.0, 1024.0).alias("y"))
