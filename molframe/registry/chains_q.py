"""Queries on the event binding: events of a user as residues of a chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe import bindings as B
from molframe.functions.geom import snap
from molframe.operators import chains as H
from molframe.operators import msa
from molframe.plans.ordered import Ordered
from molframe.plans.ranks import quantiles
from molframe.registry.base import query, with_
from molframe.registry.points_q import rsnap

KEY, ORDER = ["entry"], ["pos", "event_id"]


@query("runs", "E1", with_(B.EVT) + """, f AS (SELECT *, CASE WHEN lag(code) OVER w IS DISTINCT FROM code THEN 1 ELSE 0 END AS s FROM evt WINDOW w AS (PARTITION BY entry ORDER BY pos, event_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY entry ORDER BY pos, event_id)::BIGINT AS run FROM f)
SELECT entry, run, any_value(code) AS code, count(*) AS residues, min(pos) AS first, max(pos) AS last FROM g GROUP BY entry, run""")
def runs(spark, sf):
    return H.code_runs(B.chains(spark, sf), KEY, ORDER, F.col("block"), "code")


GAP = 14400000000


@query("na_strands", "E10 L5", with_(B.EVT) + f""", f AS (SELECT *, CASE WHEN lag(pos) OVER w IS NULL OR pos - lag(pos) OVER w > {GAP} THEN 1 ELSE 0 END AS s FROM evt WINDOW w AS (PARTITION BY entry ORDER BY pos, event_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY entry ORDER BY pos, event_id)::BIGINT AS strand FROM f)
SELECT entry, strand, count(*) AS residues, min(pos) AS first, max(pos) AS last FROM g GROUP BY entry, strand""")
def strands(spark, sf):
    gap = F.col("pos") - F.col("prev_pos") > GAP
    d = H.split_at_gaps(B.chains(spark, sf), KEY, ORDER, F.col("block"), gap)
    return d.groupBy("entry", "strand").agg(F.count(F.lit(1)).alias("residues"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query("peptide_link", "B5", with_(B.EVT) + """, f AS (SELECT event_id, coalesce(abs(value - lag(value) OVER (PARTITION BY entry ORDER BY pos, event_id)) < 10, false) AS prev FROM evt) SELECT * FROM f""")
def link(spark, sf):
    ok = F.abs(F.col("value") - F.col("prev_value")) < 10
    return H.peptide_link(B.chains(spark, sf), KEY, ORDER, F.col("block"), ok, ["value"]).select("event_id", "prev")


@query("nearest_label", "C27", with_(B.EVT) + """, k AS (SELECT entry, pos, event_id, CASE WHEN code = 'purchase' THEN event_id END AS lab FROM evt),
b AS (SELECT *, last_value(CASE WHEN lab IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS bp, last_value(lab IGNORE NULLS) OVER w AS bl,
 first_value(CASE WHEN lab IS NOT NULL THEN pos END IGNORE NULLS) OVER v AS np, first_value(lab IGNORE NULLS) OVER v AS nl FROM k
 WINDOW w AS (PARTITION BY entry ORDER BY pos, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  v AS (PARTITION BY entry ORDER BY pos, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, CASE WHEN bl IS NULL THEN nl WHEN nl IS NULL OR pos - bp <= np - pos THEN bl ELSE nl END AS nearest FROM b""")
def nearest(spark, sf):
    d = B.chains(spark, sf).withColumn("lab", F.when(F.col("code") == "purchase", F.col("event_id")))
    return H.nearest_label(d, KEY, "pos", ORDER, F.col("block"), "lab").select("event_id", "nearest")


@query("grades", "D9 K12", with_(B.EVT) + """, s AS (SELECT entry, avg(value) AS m, stddev_pop(value) AS s FROM evt GROUP BY entry)
SELECT event_id, CASE WHEN value IS NULL THEN 0 WHEN s < 1e-9 THEN 5 ELSE least(9, greatest(1, floor((value - m) / nullif(s, 0) / 0.5 + 0.5)::INT + 5)) END::INT AS grade FROM evt JOIN s USING (entry)""")
def grades(spark, sf):
    return msa.grades(B.chains(spark, sf), ["entry"], "value").select("event_id", "grade")


MARKS = """ix AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY pos, event_id) AS i FROM evt),
lab AS (SELECT entry, i, floor(i / 9.0)::BIGINT % 3 AS auto, CASE WHEN value >= 40 THEN 'x' ELSE code[1] END AS ref FROM ix),
lb AS (SELECT *, lag(auto) OVER w AS pa, lag(ref) OVER w AS pr FROM lab WINDOW w AS (PARTITION BY entry ORDER BY i)),
ra AS (SELECT entry, i - 0.5 AS pos FROM lb WHERE pr <> ref), aa AS (SELECT entry, i - 0.5 AS pos FROM lb WHERE pa <> auto)"""


@query("boundary_scores", "D14", with_(B.EVT, MARKS) + f""", c AS (SELECT entry, (SELECT count(*) FROM ra r WHERE r.entry = e.entry) AS n_ref, (SELECT count(*) FROM aa a WHERE a.entry = e.entry) AS n_auto,
 (SELECT count(*) FROM ra r WHERE r.entry = e.entry AND EXISTS (SELECT 1 FROM aa a WHERE a.entry = r.entry AND abs(a.pos - r.pos) <= 3)) AS found,
 (SELECT count(*) FROM aa a WHERE a.entry = e.entry AND EXISTS (SELECT 1 FROM ra r WHERE a.entry = r.entry AND abs(a.pos - r.pos) <= 3)) AS right_ FROM (SELECT DISTINCT entry FROM evt) e),
d AS (SELECT *, CASE WHEN n_ref > 0 THEN found / n_ref::DOUBLE ELSE 1.0 END AS recall, CASE WHEN n_auto > 0 THEN right_ / n_auto::DOUBLE WHEN n_ref = 0 THEN 1.0 ELSE 0.0 END AS precision FROM c)
SELECT entry, n_ref, n_auto, found, right_ AS "right", {rsnap('recall')} AS recall, {rsnap('precision')} AS precision, {rsnap('CASE WHEN recall + precision > 0 THEN 2.0 * recall * precision / (recall + precision) ELSE 0.0 END')} AS f1 FROM d""")
def boundaries(spark, sf):
    d = Ordered(B.chains(spark, sf), KEY, ORDER, F.col("block")).row_number("i").done()
    d = d.select("entry", "i", (F.floor(F.col("i") / 9).cast("bigint") % 3).alias("auto"),
                 F.when(F.col("value") >= 40, F.lit("x")).otherwise(F.substring("code", 1, 1)).alias("ref"))
    blk = F.floor(F.col("i") / 4096).cast("bigint")
    mark = lambda c: H.label_boundaries(d, KEY, "i", ["i"], blk, c)
    out = H.boundary_scores(mark("ref"), mark("auto"), d, KEY, 3.0)
    return out.select("entry", "n_ref", "n_auto", "found", "right", *[snap(F.col(c)).alias(c) for c in ("recall", "precision", "f1")])


@query("quartiles", "D20", with_(B.EVT) + f""" SELECT code, count(*) AS n, min(value) AS least, {rsnap('quantile_cont(value, 0.25)', 100000)} AS q1, {rsnap('quantile_cont(value, 0.5)', 100000)} AS median,
 {rsnap('quantile_cont(value, 0.75)', 100000)} AS q3, max(value) AS most FROM evt GROUP BY code""")
def quarts(spark, sf):
    q = quantiles(B.chains(spark, sf), ["code"], "value", {"least": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "most": 1.0})
    return q.select("code", "n", "least", *[snap(F.col(c), 1e5).alias(c) for c in ("q1", "median", "q3")], "most")


@query("flank_residues", "E18", with_(B.EVT) + """, h AS (SELECT DISTINCT entry, block AS seq FROM evt), e AS (SELECT DISTINCT entry, block AS seq FROM evt WHERE code = 'error'),
t AS (SELECT *, seq - row_number() OVER (PARTITION BY entry ORDER BY seq) AS piece FROM h),
m AS (SELECT t.*, e.seq IS NOT NULL AS inside FROM t LEFT JOIN e USING (entry, seq))
SELECT a.entry, a.seq FROM m a WHERE NOT a.inside AND EXISTS (SELECT 1 FROM m b WHERE b.entry = a.entry AND b.piece = a.piece AND b.inside AND abs(a.seq - b.seq) <= 2)""")
def flanks(spark, sf):
    h = B.chains(spark, sf).groupBy("entry", F.col("block").alias("seq")).agg(F.max((F.col("code") == "error").cast("int")).alias("hit"))
    blk = F.floor(F.col("seq") / 4096).cast("bigint")
    return H.flank_residues(h, KEY, "seq", ["seq"], blk, F.col("hit") == 1, 2).select("entry", "seq")


@query("ligand_label", "E19", with_(B.EVT) + """, f AS (SELECT *, CASE WHEN lag(code) OVER w IS DISTINCT FROM code THEN 1 ELSE 0 END AS s FROM evt WINDOW w AS (PARTITION BY entry ORDER BY pos, event_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY entry ORDER BY pos, event_id) AS run FROM f),
r AS (SELECT entry, run, any_value(code) AS code, count(*) AS n FROM g GROUP BY entry, run)
SELECT entry, floor((run - 1) / 4096)::BIGINT AS part, string_agg(CASE WHEN n > 1 THEN code || 'x' || n ELSE code END, '-' ORDER BY run) AS label FROM r GROUP BY entry, part""")
def label(spark, sf):
    return H.compress_names(B.chains(spark, sf), KEY, ORDER, F.col("block"), "code")


@query("crop_strands", "B16", with_(B.EVT) + """, h AS (SELECT entry, min(block) AS lo, max(block) AS hi FROM evt GROUP BY entry),
t AS (SELECT DISTINCT e.entry, block, greatest(block - 3, lo) AS a, least(block + 3, hi) AS b, lo FROM evt e JOIN h USING (entry) WHERE code = 'signup'),
f AS (SELECT *, CASE WHEN lag(b) OVER w IS NULL OR a - lag(b) OVER w - 1 >= 12 THEN 1 ELSE 0 END AS s FROM t WINDOW w AS (PARTITION BY entry ORDER BY block)),
g AS (SELECT *, sum(s) OVER (PARTITION BY entry ORDER BY block)::BIGINT AS piece FROM f),
p AS (SELECT entry, piece, min(a) AS first, max(b) AS last, any_value(lo) AS lo FROM g GROUP BY entry, piece)
SELECT entry, piece, first, last, first - coalesce(lag(last) OVER (PARTITION BY entry ORDER BY piece) + 1, lo) AS missing FROM p""")
def crop(spark, sf):
    d = B.chains(spark, sf).select("entry", F.col("block").alias("p"), "code")
    return H.crop_strands(d, KEY, "p", d.filter("code = 'signup'"), 3)


@query("track_positions", "E15", with_(B.EVT) + """, h AS (SELECT entry, unnest(range(min(block), max(block) + 1)) AS pos FROM evt GROUP BY entry),
m AS (SELECT entry, block AS pos, min(event_id) AS number FROM evt GROUP BY entry, block),
j AS (SELECT h.entry, h.pos, m.number, m.pos IS NOT NULL AS observed, CASE WHEN m.pos IS NOT NULL THEN h.pos END AS mp, number - h.pos AS off FROM h LEFT JOIN m ON m.entry = h.entry AND m.pos = h.pos),
b AS (SELECT *, last_value(mp IGNORE NULLS) OVER w AS bp, last_value(off IGNORE NULLS) OVER w AS bo, first_value(mp IGNORE NULLS) OVER v AS np, first_value(off IGNORE NULLS) OVER v AS no FROM j
 WINDOW w AS (PARTITION BY entry ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY entry ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT entry, pos, observed, pos + CASE WHEN np IS NULL OR pos - bp <= np - pos THEN bo ELSE no END AS number FROM b""")
def track(spark, sf):
    d = B.chains(spark, sf)
    m = d.groupBy("entry", F.col("block").alias("pos")).agg(F.min("event_id").alias("number"))
    s = d.groupBy("entry").agg(F.min("block").alias("first"), F.max("block").alias("last")).withColumn("name", F.lit("X"))
    return H.track_positions(s, m, KEY).drop("name")


@query("hydropathy", "B12", with_(B.EVT) + """, m AS (SELECT entry, max(value) AS top FROM evt WHERE code = 'view' GROUP BY entry)
SELECT event_id, CASE WHEN top <= 1.0 THEN value * 100 ELSE value END AS plddt,
 CASE WHEN value > 90 THEN 'very high' WHEN value > 70 THEN 'confident' WHEN value > 50 THEN 'low' ELSE 'very low' END AS band,
 CASE code WHEN 'view' THEN 4.5 WHEN 'click' THEN -4.5 ELSE 0.0 END::DOUBLE AS hydropathy FROM evt JOIN m USING (entry)""")
def hydropathy(spark, sf):
    from molframe.functions import chemistry as chem

    d = B.chains(spark, sf)
    top = d.filter("code = 'view'").groupBy("entry").agg(F.max("value").alias("top"))
    j = d.join(top, "entry")
    p = chem.plddt(F.col("value"), F.col("top"))
    name = F.when(F.col("code") == "view", "ILE").when(F.col("code") == "click", "ARG").otherwise("UNK")
    return j.select("event_id", p.alias("plddt"), chem.plddt_band(p).alias("band"), chem.hydropathy(name).alias("hydropathy"))
