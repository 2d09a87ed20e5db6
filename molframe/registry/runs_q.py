"""Queries on two runs: the halves of a month of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe import bindings as B
from molframe.functions.geom import snap
from molframe.operators import campaign as C
from molframe.registry.base import query, with_
from molframe.registry.campaign_q import swilson
from molframe.registry.points_q import rsnap

CODES = """code2 AS (SELECT run, entry, slot, arg_min(code, event_id) AS code FROM run2 GROUP BY ALL)"""


def codes(spark, sf):
    return B.runs_ab(spark, sf).groupBy("run", "entry", "slot").agg(F.min_by("code", "event_id").alias("code"))


def side(df, run):
    return df.filter(F.col("run") == run).drop("run")


@query("code_agreement", "D24", with_(B.RUN2, CODES) + f""", a AS (SELECT * FROM code2 WHERE run = 'a'), b AS (SELECT * FROM code2 WHERE run = 'b'),
j AS (SELECT coalesce(a.entry, b.entry) AS entry, a.code AS ca, b.code AS cb FROM a FULL JOIN b ON a.entry = b.entry AND a.slot = b.slot)
SELECT entry, count(*) FILTER (WHERE ca IS NOT NULL AND cb IS NOT NULL) AS compared, count(*) FILTER (WHERE ca = cb) AS equal, count(*) FILTER (WHERE cb IS NULL) AS only_a,
 count(*) FILTER (WHERE ca IS NULL) AS only_b, {rsnap('count(*) FILTER (WHERE ca = cb) / nullif(count(*) FILTER (WHERE ca IS NOT NULL AND cb IS NOT NULL), 0)::DOUBLE')} AS share FROM j GROUP BY entry""")
def agreement(spark, sf):
    c = codes(spark, sf)
    return C.code_agreement(side(c, "a"), side(c, "b"), ["entry"], "slot").withColumn("share", snap(F.col("share")))


@query("gained_lost", "C29", with_(B.RUN2) + """, a AS (SELECT DISTINCT entry, slot, code FROM run2 WHERE run = 'a'), b AS (SELECT DISTINCT entry, slot, code FROM run2 WHERE run = 'b')
SELECT *, 'lost' AS status FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'gained' FROM (FROM b EXCEPT FROM a)""")
def gained(spark, sf):
    r = B.runs_ab(spark, sf)
    return C.gained_lost(side(r, "a"), side(r, "b"), ["entry", "slot", "code"])


@query("ss_changes", "C30", with_(B.RUN2, CODES) + """, a AS (SELECT * FROM code2 WHERE run = 'a'), b AS (SELECT * FROM code2 WHERE run = 'b')
SELECT coalesce(a.entry, b.entry) AS entry, coalesce(a.slot, b.slot) AS slot, coalesce(a.code, '-') AS kind_a, coalesce(b.code, '-') AS kind_b FROM a FULL JOIN b ON a.entry = b.entry AND a.slot = b.slot
WHERE a.code IS DISTINCT FROM b.code AND (a.code IS NULL OR b.code IS NULL OR a.code <> b.code)""")
def ss_changes(spark, sf):
    from molframe.operators.compare import ss_changes as changes

    c = codes(spark, sf)
    same = B.runs_ab(spark, sf).select("entry", F.col("slot").alias("i"), F.col("slot").alias("j")).distinct()
    out = changes(side(c, "a"), side(c, "b"), same, ["entry"], "slot")
    return out.select("entry", F.coalesce("i", "j").alias("slot"), "kind_a", "kind_b")


@query("alignment_agreement", "D26", with_(B.RUN2) + f""", a AS (SELECT entry, slot AS i, min(event_id) % 50 AS j FROM run2 WHERE run = 'a' GROUP BY ALL), b AS (SELECT entry, slot AS i, min(event_id) % 50 AS j FROM run2 WHERE run = 'b' GROUP BY ALL)
SELECT a.entry, count(*) AS pairs, count(*) FILTER (WHERE abs(a.j - b.j) <= 8) AS reproduced, {rsnap('count(*) FILTER (WHERE abs(a.j - b.j) <= 8) / count(*)::DOUBLE')} AS share FROM a LEFT JOIN b ON a.entry = b.entry AND a.i = b.i GROUP BY a.entry""")
def align(spark, sf):
    r = B.runs_ab(spark, sf).groupBy("run", "entry", F.col("slot").alias("i")).agg((F.min("event_id") % 50).alias("j"))
    return C.alignment_agreement(side(r, "a"), side(r, "b"), ["entry"], 8).withColumn("share", snap(F.col("share")))


@query("alignment_departures", "D26", with_(B.RUN2) + """, a AS (SELECT entry, slot AS i, min(event_id) % 50 AS j FROM run2 WHERE run = 'a' GROUP BY ALL), b AS (SELECT entry, slot AS i, min(event_id) % 50 AS j FROM run2 WHERE run = 'b' GROUP BY ALL),
h AS (SELECT a.entry, a.i, b.j - a.j AS shift, coalesce(abs(a.j - b.j) <= 8, false) AS hit FROM a LEFT JOIN b ON a.entry = b.entry AND a.i = b.i),
f AS (SELECT *, CASE WHEN lag(hit) OVER w IS DISTINCT FROM hit THEN 1 ELSE 0 END AS s FROM h WINDOW w AS (PARTITION BY entry ORDER BY i)),
g AS (SELECT *, sum(s) OVER (PARTITION BY entry ORDER BY i) AS run FROM f)
SELECT entry, min(i) AS first, max(i) AS last, count(*) AS pairs, coalesce(arg_min_null(shift, i), 0) AS shift FROM g WHERE NOT hit GROUP BY entry, run""")
def departures(spark, sf):
    r = B.runs_ab(spark, sf).groupBy("run", "entry", F.col("slot").alias("i")).agg((F.min("event_id") % 50).alias("j"))
    return C.alignment_departures(side(r, "a"), side(r, "b"), ["entry"], 8).fillna(0, ["shift"])


KEYS = """keys2 AS (SELECT run, entry, bool_and(value < 300) AS pass, count(*) FILTER (WHERE code = 'error') AS cnt, floor(max(value))::BIGINT AS area,
 list_sort(list(DISTINCT code) FILTER (WHERE value >= 150)) AS failing FROM run2 GROUP BY run, entry)"""


def keys(spark, sf):
    r = B.runs_ab(spark, sf)
    return r.groupBy("run", "entry").agg(
        F.bool_and(F.col("value") < 300).alias("pass"), F.count_if(F.col("code") == "error").alias("count"), F.floor(F.max("value")).alias("area"),
        F.array_sort(F.collect_set(F.when(F.col("value") >= 150, F.col("code")))).alias("failing"),
    )


MOVED = """a AS (SELECT *, coalesce(failing, []) AS f FROM keys2 WHERE run = 'a'), b AS (SELECT *, coalesce(failing, []) AS f FROM keys2 WHERE run = 'b'),
mv AS (SELECT a.entry, 'pass' AS what, a.pass::VARCHAR || ' -> ' || b.pass::VARCHAR AS name FROM a JOIN b USING (entry) WHERE a.pass <> b.pass
 UNION ALL SELECT a.entry, 'count', a.cnt || ' -> ' || b.cnt FROM a JOIN b USING (entry) WHERE a.cnt <> b.cnt
 UNION ALL SELECT a.entry, 'area', a.area || ' -> ' || b.area FROM a JOIN b USING (entry) WHERE a.area <> b.area
 UNION ALL SELECT entry, 'now fails', unnest(list_filter(bf, lambda k: NOT list_contains(af, k))) FROM (SELECT a.entry, a.f AS af, b.f AS bf FROM a JOIN b USING (entry))
 UNION ALL SELECT entry, 'now passes', unnest(list_filter(af, lambda k: NOT list_contains(bf, k))) FROM (SELECT a.entry, a.f AS af, b.f AS bf FROM a JOIN b USING (entry))
 UNION ALL SELECT coalesce(a.entry, b.entry), 'in one run only', CASE WHEN a.entry IS NULL THEN 'b' ELSE 'a' END FROM a FULL JOIN b ON a.entry = b.entry WHERE a.entry IS NULL OR b.entry IS NULL)"""


@query("moved", "G2", with_(B.RUN2, KEYS, MOVED) + " SELECT entry, what, name FROM mv")
def moved(spark, sf):
    k = keys(spark, sf)
    return C.moved(side(k, "a"), side(k, "b"))


@query("judge_run", "G3", with_(B.RUN2, KEYS, MOVED) + """, n AS (SELECT (SELECT count(*) FILTER (WHERE pass) FROM b) - (SELECT count(*) FILTER (WHERE pass) FROM a) AS d,
 (SELECT count(*) FROM (SELECT DISTINCT unnest(f) FROM b EXCEPT SELECT DISTINCT unnest(f) FROM a)) AS nf, (SELECT count(*) FROM mv) AS c)
SELECT CASE WHEN abs(d) >= 3 OR nf > 0 THEN 'fragile' WHEN c > 0 THEN 'sensitive' ELSE 'stable' END AS class, d AS pass_delta, nf AS new_failing, c AS changes FROM n""")
def judge(spark, sf):
    k = keys(spark, sf)
    a, b = side(k, "a"), side(k, "b")
    return C.judge_run(a, b, C.moved(a, b))


@query("compare_layouts", "G4", with_(B.RUN2) + """, k AS (SELECT run, entry, slot, count(*) AS n, max(value) AS top FROM run2 GROUP BY ALL), a AS (SELECT * FROM k WHERE run = 'a'), b AS (SELECT * FROM k WHERE run = 'b'),
j AS (SELECT coalesce(a.entry, b.entry) AS entry, a.n AS na, b.n AS nb, a.top AS ta, b.top AS tb FROM a FULL JOIN b ON a.entry = b.entry AND a.slot = b.slot)
SELECT entry, count(*) FILTER (WHERE na = nb AND ta = tb) AS equal, count(*) FILTER (WHERE na IS NOT NULL AND nb IS NOT NULL AND NOT (na = nb AND ta = tb)) AS changed,
 count(*) FILTER (WHERE nb IS NULL) AS missing_b, count(*) FILTER (WHERE na IS NULL) AS missing_a, count(*) FILTER (WHERE tb > ta * 1.5) AS grew FROM j GROUP BY entry""")
def layouts(spark, sf):
    k = B.runs_ab(spark, sf).groupBy("run", "entry", "slot").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return C.compare_layouts(side(k, "a"), side(k, "b"), ["entry", "slot"], "entry", ["n", "top"], ("top", 1.5))


@query("known_check", "G6", with_(B.RUN2) + """, a AS (SELECT DISTINCT entry, code FROM run2 WHERE run = 'a'), b AS (SELECT DISTINCT entry, code FROM run2 WHERE run = 'b')
SELECT a.entry, a.code, b.entry IS NOT NULL AS found FROM a LEFT JOIN b USING (entry, code)""")
def known(spark, sf):
    r = B.runs_ab(spark, sf).select("run", "entry", "code").distinct()
    return C.known_check(side(r, "a"), side(r, "b"), ["entry", "code"])


@query("worse_measures", "G7", with_(B.RUN2) + """, k AS (SELECT run, entry, count(*)::DOUBLE AS bonds, max(value) AS clash FROM run2 GROUP BY ALL),
u AS (SELECT run, entry, 'bonds' AS measure, bonds AS v FROM k UNION ALL SELECT run, entry, 'clash', clash FROM k), a AS (SELECT * FROM u WHERE run = 'a'), b AS (SELECT * FROM u WHERE run = 'b')
SELECT coalesce(a.entry, b.entry) AS entry, coalesce(a.measure, b.measure) AS measure, a.v AS before, b.v AS after,
 CASE WHEN b.v IS NULL THEN true WHEN a.v IS NULL THEN false WHEN a.measure = 'bonds' THEN b.v < a.v ELSE b.v > a.v END AS worse FROM a FULL JOIN b ON a.entry = b.entry AND a.measure = b.measure WHERE a.v IS DISTINCT FROM b.v""")
def worse(spark, sf):
    k = B.runs_ab(spark, sf).groupBy("run", "entry").agg(F.count(F.lit(1)).cast("double").alias("bonds"), F.max("value").alias("clash"))
    return C.worse_measures(side(k, "a"), side(k, "b"), ["entry"], {"bonds": True, "clash": False})


@query("named_totals", "D23", with_(B.RUN2) + """ SELECT code AS name, count(DISTINCT entry) AS entries, count(*) FILTER (WHERE run = 'a') AS first_view, count(*) AS all_views FROM run2 GROUP BY code""")
def totals(spark, sf):
    r = B.runs_ab(spark, sf).withColumn("one", F.lit(1)).withColumnRenamed("code", "name")
    return C.named_totals(r, "name", "entry", "one", F.col("run") == "a")


@query("binned_histogram", "D30", with_(B.RUN2) + """ SELECT CASE WHEN value >= 100 THEN 4 WHEN value >= 75 THEN 3 WHEN value >= 50 THEN 2 WHEN value >= 25 THEN 1 ELSE 0 END AS bin, count(*) AS entries FROM run2 WHERE value >= 0 GROUP BY bin""")
def hist(spark, sf):
    return C.binned_histogram(B.runs_ab(spark, sf), "value", [0.0, 25.0, 50.0, 75.0, 100.0])


@query("option_effects", "D38", with_(B.RUN2) + f""" SELECT code AS option, count(*) AS tried, count(*) FILTER (WHERE value > 40) AS brought_above, {rsnap('quantile_cont(value, 0.5)', 100000)} AS median_seconds,
 {rsnap('quantile_cont(slot, 0.5)')} AS median_size FROM run2 GROUP BY code""")
def effects(spark, sf):
    r = B.runs_ab(spark, sf).select(F.col("code").alias("option"), (F.col("value") > 40).alias("above"), F.col("value").alias("seconds"), F.col("slot").alias("size"))
    e = C.option_effects(r)
    return e.select("option", "tried", "brought_above", snap(F.col("median_seconds"), 1e5).alias("median_seconds"), snap(F.col("median_size")).alias("median_size"))


PL, PH = swilson("(0.95 * n)", "n")


@query("quantile_interval", "D41", with_(B.RUN2) + f""", n AS (SELECT code, count(*) AS n FROM run2 GROUP BY code), w AS (SELECT code, n, greatest(1, floor(n * {PL})) AS a, least(n, ceil(n * {PH})) AS b FROM n),
o AS (SELECT code, value, row_number() OVER (PARTITION BY code ORDER BY value) AS k FROM run2)
SELECT code, n, {rsnap('(SELECT quantile_cont(value, 0.95) FROM run2 r WHERE r.code = w.code)', 100000)} AS value, (SELECT value FROM o WHERE o.code = w.code AND k = a) AS low, (SELECT value FROM o WHERE o.code = w.code AND k = b) AS high FROM w""")
def interval(spark, sf):
    q = C.quantile_interval(B.runs_ab(spark, sf), ["code"], "value", 0.95)
    return q.select("code", "n", snap(F.col("value"), 1e5).alias("value"), "low", "high")


@query("contact_report", "D27", with_(B.RUN2) + """, a AS (SELECT DISTINCT entry, slot FROM run2 WHERE run = 'a'), b AS (SELECT DISTINCT entry, slot FROM run2 WHERE run = 'b'), d AS (SELECT DISTINCT entry, slot FROM run2 WHERE value < 50)
SELECT coalesce(a.entry, b.entry) AS entry, coalesce(a.slot, b.slot) AS slot, CASE WHEN a.entry IS NOT NULL AND b.entry IS NOT NULL THEN 'verified' WHEN a.entry IS NULL THEN 'false'
 WHEN d.entry IS NULL THEN 'missing: not drawn' ELSE 'missing' END AS status FROM a FULL JOIN b ON a.entry = b.entry AND a.slot = b.slot LEFT JOIN d ON d.entry = coalesce(a.entry, b.entry) AND d.slot = coalesce(a.slot, b.slot)""")
def report(spark, sf):
    r = B.runs_ab(spark, sf)
    return C.contact_report(side(r, "a"), side(r, "b"), ["entry", "slot"], r.filter("value < 50"))


@query("pair_set_scores", "D25", with_(B.RUN2) + f""", p AS (SELECT DISTINCT run, code AS grp, least(entry, slot) AS a, greatest(entry, slot) AS b FROM run2), g AS (SELECT * FROM p WHERE run = 'a'), r AS (SELECT * FROM p WHERE run = 'b'),
j AS (SELECT coalesce(g.grp, r.grp) AS grp, g.a AS ga, r.a AS ra FROM g FULL JOIN r ON g.grp = r.grp AND g.a = r.a AND g.b = r.b)
SELECT grp, count(ga) AS n_got, count(ra) AS n_ref, count(*) FILTER (WHERE ga IS NOT NULL AND ra IS NOT NULL) AS shared, {rsnap('count(*) FILTER (WHERE ga IS NOT NULL AND ra IS NOT NULL) / nullif(count(ga), 0)::DOUBLE')} AS precision,
 {rsnap('count(*) FILTER (WHERE ga IS NOT NULL AND ra IS NOT NULL) / nullif(count(ra), 0)::DOUBLE')} AS recall, {rsnap('2.0 * count(*) FILTER (WHERE ga IS NOT NULL AND ra IS NOT NULL) / (count(ga) + count(ra))')} AS f1 FROM j GROUP BY grp""")
def pairs(spark, sf):
    r = B.runs_ab(spark, sf).select("run", F.col("code").alias("grp"), F.col("entry").alias("a"), F.col("slot").alias("b"))
    s = C.pair_set_scores(side(r, "a"), side(r, "b"), ["grp"])
    return s.select("grp", "n_got", "n_ref", "shared", *[snap(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


OVER = """o AS (SELECT a.entry, a.code AS r, b.code AS u, count(*) AS n FROM code2 a JOIN code2 b ON a.run = 'a' AND b.run = 'b' AND a.entry = b.entry AND a.slot = b.slot GROUP BY ALL),
ref AS (SELECT entry, r, row_number() OVER (PARTITION BY entry ORDER BY r) AS k FROM (SELECT DISTINCT entry, r FROM o)),
walk AS (SELECT DISTINCT entry, 0::BIGINT AS k, []::VARCHAR[] AS used, 0::BIGINT AS got FROM o UNION ALL
 SELECT w.entry, w.k + 1, CASE WHEN o.u IS NULL THEN w.used ELSE list_append(w.used, o.u) END, w.got + coalesce(o.n, 0) FROM walk w JOIN ref ON ref.entry = w.entry AND ref.k = w.k + 1
 JOIN (SELECT entry, r, u, n FROM o UNION ALL SELECT entry, r, NULL, 0 FROM ref) o ON o.entry = w.entry AND o.r = ref.r AND (o.u IS NULL OR NOT list_contains(w.used, o.u)))"""


@query("label_overlap", "D13", with_(B.RUN2, CODES, OVER) + f""", j AS (SELECT entry, sum(n)::BIGINT AS judged FROM o GROUP BY entry)
SELECT entry, judged, max(got) AS matched, {rsnap('max(got) / judged::DOUBLE')} AS overlap FROM walk JOIN j USING (entry) GROUP BY entry, judged""")
def overlap(spark, sf):
    c = codes(spark, sf)
    j = side(c, "a").select("entry", "slot", F.col("code").alias("ref")).join(side(c, "b").select("entry", "slot", F.col("code").alias("auto")), ["entry", "slot"])
    return C.label_overlap(j, ["entry"]).withColumn("overlap", snap(F.col("overlap")))
