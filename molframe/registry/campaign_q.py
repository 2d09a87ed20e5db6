"""Queries on the campaign binding: documents as judged entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe import bindings as B
from molframe.functions import text as T
from molframe.functions.geom import snap
from molframe.functions.stats import wilson
from molframe.operators import campaign as C
from molframe.operators import sampling as S
from molframe.plans import ranks as R
from molframe.registry.base import query, with_
from molframe.registry.points_q import rsnap

Z = "1.959963984540054"


def swilson(k: str, n: str) -> tuple[str, str]:
    p = f"({k}::DOUBLE / {n})"
    den = f"(1.0 + {Z} * {Z} / {n})"
    mid = f"(({p} + {Z} * {Z} / (2.0 * {n})) / {den})"
    half = f"({Z} * sqrt({p} * (1.0 - {p}) / {n} + {Z} * {Z} / (4.0 * {n}::DOUBLE * {n})) / {den})"
    lo = f"CASE WHEN {n} = 0 THEN NULL WHEN {k} = 0 THEN 0.0 ELSE greatest(0.0, {mid} - {half}) END"
    hi = f"CASE WHEN {n} = 0 THEN NULL WHEN {k} = {n} THEN 1.0 ELSE least(1.0, {mid} + {half}) END"
    return lo, hi


OUT = """outc AS (SELECT entry, stratum, 'Q' AS criterion, CASE WHEN q IS NULL THEN 'not judged' WHEN q THEN 'pass' ELSE 'fail' END AS outcome FROM camp
 UNION ALL SELECT entry, stratum, 'T', CASE WHEN stratum = 'es' THEN 'does not apply' WHEN t IS NULL THEN 'not judged' WHEN t THEN 'pass' ELSE 'fail' END FROM camp)"""


def outcome_rows(spark, sf):
    c = B.campaign(spark, sf)
    q = F.struct(F.lit("Q").alias("criterion"), C.outcome(F.col("q"), F.lit(True)).alias("outcome"))
    t = F.struct(F.lit("T").alias("criterion"), C.outcome(F.col("t"), F.col("stratum") != "es").alias("outcome"))
    return c.select("entry", "stratum", F.explode(F.array(q, t)).alias("o")).select("entry", "stratum", "o.*")


@query("outcomes", "D21", with_(B.CAMP, OUT) + """ SELECT criterion, stratum, count(*) FILTER (WHERE outcome = 'pass') AS pass, count(*) FILTER (WHERE outcome = 'fail') AS fail,
 count(*) FILTER (WHERE outcome = 'not judged') AS not_judged, count(*) FILTER (WHERE outcome = 'does not apply') AS does_not_apply, grouping_id(criterion, stratum)::BIGINT AS level
FROM outc GROUP BY GROUPING SETS ((criterion), (stratum), ())""")
def outcomes(spark, sf):
    return C.outcome_counts(outcome_rows(spark, sf))


@query("entry_passes", "D21", with_(B.CAMP, OUT) + """, e AS (SELECT entry, stratum, count(*) FILTER (WHERE outcome = 'fail') AS f FROM outc GROUP BY ALL)
SELECT stratum, count(*) AS entries, count(*) FILTER (WHERE f = 0) AS passing FROM e GROUP BY stratum""")
def passes(spark, sf):
    return C.entry_passes(outcome_rows(spark, sf))


@query("count_check", "D22", with_(B.CAMP) + """, b AS (SELECT stratum, source, entry, size, size > 6000 AS bad FROM camp),
w AS (SELECT *, row_number() OVER (PARTITION BY stratum, source ORDER BY entry) AS k FROM b WHERE bad)
SELECT stratum, source, count(*) AS views, count(*) FILTER (WHERE bad) AS bad, count(*) FILTER (WHERE bad) = 0 AS passes,
 coalesce((SELECT string_agg(w.entry, ', ' ORDER BY w.entry) FROM w WHERE w.stratum = b.stratum AND w.source = b.source), '') AS "where" FROM b GROUP BY stratum, source""")
def count_check(spark, sf):
    return C.count_check(B.campaign(spark, sf), ["stratum", "source"], "entry", "size", 6000)


@query("mean_scores", "D16", with_(B.CAMP) + f" SELECT stratum, count(*) AS n, {rsnap('avg(size)')} AS size, {rsnap('avg(CASE WHEN q THEN 1.0 ELSE 0.0 END)')} AS q FROM camp WHERE q IS NOT NULL GROUP BY stratum")
def means(spark, sf):
    c = B.campaign(spark, sf).filter("q is not null").withColumn("q", F.col("q").cast("double"))
    m = C.mean_scores(c, ["stratum"], ["size", "q"])
    return m.select("stratum", "n", snap(F.col("size")).alias("size"), snap(F.col("q")).alias("q"))


@query("below_targets", "D16", with_(B.CAMP) + """ SELECT entry, concat_ws(', ', CASE WHEN size < 500 THEN 'size' END, CASE WHEN q::INT < 0.5 THEN 'q' END) AS under FROM camp WHERE q IS NOT NULL AND (size < 500 OR NOT q)""")
def targets(spark, sf):
    c = B.campaign(spark, sf).filter("q is not null").withColumn("q", F.col("q").cast("int"))
    return C.below_targets(c, {"size": 500.0, "q": 0.5}).select("entry", "under")


EDGES = [0.0, 0.25, 0.5, 0.75, 1.0]
CONF = "conf AS (SELECT *, least(1.0, size / 8000.0) AS c FROM camp WHERE q IS NOT NULL)"
LO, HI = swilson("k", "n")


@query("calibration", "D17", with_(B.CAMP, CONF) + f""", b AS (SELECT stratum, CASE WHEN c < 0.25 THEN 0 WHEN c < 0.5 THEN 1 WHEN c < 0.75 THEN 2 ELSE 3 END AS bin, count(*) AS n, count(*) FILTER (WHERE q) AS k FROM conf GROUP BY ALL)
SELECT stratum, bin, n, k, {rsnap(LO)} AS low, {rsnap(HI)} AS high FROM b""")
def calibration(spark, sf):
    c = B.campaign(spark, sf).filter("q is not null").withColumn("c", F.least(F.lit(1.0), F.col("size") / 8000.0))
    g = C.calibration(c, ["stratum"], "c", F.col("q"), EDGES)
    return g.select("stratum", "bin", "n", "k", snap(F.col("low")).alias("low"), snap(F.col("high")).alias("high"))


@query("auc", "D18", with_(B.CAMP) + f""", r AS (SELECT stratum, q, size, rank() OVER (PARTITION BY stratum ORDER BY size) + (count(*) OVER (PARTITION BY stratum, size) - 1) / 2.0 AS mid FROM camp WHERE q IS NOT NULL)
SELECT stratum, count(*) FILTER (WHERE q) AS n_right, count(*) FILTER (WHERE NOT q) AS n_wrong,
 {rsnap('(sum(CASE WHEN q THEN mid ELSE 0 END) - count(*) FILTER (WHERE q) * (count(*) FILTER (WHERE q) + 1) / 2.0) / nullif(count(*) FILTER (WHERE q) * count(*) FILTER (WHERE NOT q), 0)')} AS auc FROM r GROUP BY stratum""")
def auc(spark, sf):
    a = R.auc(B.campaign(spark, sf), ["stratum"], "size", F.col("q"))
    return a.select("stratum", "n_right", "n_wrong", snap(F.col("auc")).alias("auc"))


@query("wilson", "D19", with_(B.CAMP) + f""", b AS (SELECT source, stratum, count(*) FILTER (WHERE q) AS k, count(q) AS n FROM camp GROUP BY ALL)
SELECT source, stratum, k, n, {rsnap(LO)} AS low, {rsnap(HI)} AS high FROM b""")
def wilson_q(spark, sf):
    g = B.campaign(spark, sf).groupBy("source", "stratum").agg(F.count_if("q").alias("k"), F.count("q").alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.select("source", "stratum", "k", "n", snap(lo).alias("low"), snap(hi).alias("high"))


@query("pool_record", "D28", with_(B.CAMP) + """, d AS (SELECT stratum, entry::VARCHAR AS id, substr(sha256(entry::VARCHAR), 1, 3) AS b FROM camp),
k AS (SELECT stratum, b, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS h FROM d GROUP BY ALL)
SELECT stratum, sum(n)::BIGINT AS n, sha256(string_agg(h, chr(10) ORDER BY b)) AS digest FROM k GROUP BY stratum""")
def pool(spark, sf):
    return C.pool_record(B.campaign(spark, sf), ["stratum"], "entry")


@query("threshold_sweep", "D37", with_(B.CAMP) + f""", t AS (SELECT *, unnest([100.0, 500.0, 2000.0, 8000.0]) AS threshold FROM camp)
SELECT stratum, threshold::DOUBLE AS threshold, count(*) AS n, count(*) FILTER (WHERE size >= threshold) AS meeting, {rsnap('avg(CASE WHEN size >= threshold THEN size END)')} AS mean FROM t GROUP BY ALL""")
def sweep(spark, sf):
    s = C.threshold_sweep(B.campaign(spark, sf), ["stratum"], "size", [100, 500, 2000, 8000])
    return s.withColumn("mean", snap(F.col("mean")))


STATUS = """half AS (SELECT *, CASE WHEN entry < 500 THEN 'first' ELSE 'second' END AS half, CASE WHEN size < 20 THEN 'refused' WHEN q IS NULL THEN 'error' WHEN q THEN 'drawn' ELSE 'failed' END AS status FROM camp)"""


@query("campaign_totals", "D42", with_(B.CAMP, STATUS) + """ SELECT half, stratum, count(*) AS entries, count(*) FILTER (WHERE status = 'drawn') AS drawn, count(*) FILTER (WHERE status = 'refused') AS refused,
 count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE status = 'failed') AS failed FROM half GROUP BY GROUPING SETS ((half, stratum), (half), ())""")
def totals(spark, sf):
    c = B.campaign(spark, sf).withColumn("half", F.when(F.col("entry") < 500, "first").otherwise("second"))
    st = F.when(F.col("size") < 20, "refused").when(F.col("q").isNull(), "error").when(F.col("q"), "drawn").otherwise("failed")
    return C.campaign_totals(c.withColumn("status", st))


@query("entry_summary", "D4", with_(B.CAMP) + """ SELECT source, count(*) AS entries, count(*) FILTER (WHERE stratum = 'en') AS english, count(q) AS judged FROM camp GROUP BY source""")
def summary(spark, sf):
    c = B.campaign(spark, sf)
    return C.entry_summary(c, {"entries": c, "english": c.filter("stratum = 'en'"), "judged": c.filter("q is not null")}, "source")


@query("code_mix", "G5", with_(B.CAMP) + " SELECT source, count(*) AS entries, (SELECT count(DISTINCT source) > 1 FROM camp) AS mixed FROM camp GROUP BY source")
def mix(spark, sf):
    return C.code_mix(B.campaign(spark, sf), "source")


BIN = "CASE WHEN size < 300 THEN 'S' WHEN size < 1500 THEN 'M' WHEN size < 8000 THEN 'L' WHEN size < 30001 THEN 'XL' ELSE 'XL+' END"


@query("size_bin", "B13", with_(B.CAMP) + f" SELECT {BIN} AS bin, stratum, count(*) AS entries FROM camp GROUP BY ALL")
def bins(spark, sf):
    return B.campaign(spark, sf).groupBy(S.size_bin(F.col("size")).alias("bin"), "stratum").agg(F.count(F.lit(1)).alias("entries"))


@query("scope_report", "B17", with_(B.CAMP) + """ SELECT 'entry' AS kind, entry::VARCHAR AS name, 'not drawn' AS reason FROM camp WHERE NOT coalesce(q, false)
 UNION ALL SELECT DISTINCT 'source', stratum || ':' || source, 'not drawn' FROM camp WHERE stratum || ':' || source NOT IN (SELECT stratum || ':' || source FROM camp WHERE q)""")
def scope(spark, sf):
    c = B.campaign(spark, sf)
    return C.scope_report(c, c.filter("q"), {"entry": ["entry"], "source": ["stratum", "source"]})


# ---------------------------------------------------------------- sampling
@query("exclude", "G1", with_(B.CAMP) + " SELECT entry, stratum FROM camp WHERE entry NOT IN (SELECT doc_id FROM labels)")
def exclude(spark, sf):
    lab = B.table(spark, sf, "labels").select(F.col("doc_id").alias("entry"))
    return S.exclude(B.campaign(spark, sf), lab, "entry").select("entry", "stratum")


@query("bucketed_order", "F4", with_(B.CAMP) + " SELECT entry, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('7:' || entry)) AS place FROM camp")
def order(spark, sf):
    return S.bucketed_order(B.campaign(spark, sf), "entry", "7", ["stratum"]).select("entry", "stratum", "place")


@query("hash_split", "I5", with_(B.CAMP) + ", r AS (SELECT entry, row_number() OVER (ORDER BY sha256('11:' || entry)) AS place FROM camp) SELECT entry, place, CASE WHEN place <= floor((SELECT count(*) FROM camp) * 0.3 + 0.5) THEN 'check' ELSE 'tune' END AS part FROM r")
def split(spark, sf):
    return S.hash_split(B.campaign(spark, sf), "entry", "11", 0.3).select("entry", "place", "part")


@query("stratified_draw", "I1", with_(B.CAMP) + f""", r AS (SELECT *, {BIN} AS bin, sha256('3:' || stratum || ':' || {BIN} || ':' || entry) AS h FROM camp),
p AS (SELECT *, row_number() OVER (PARTITION BY stratum, bin ORDER BY h) AS place FROM r),
g AS (SELECT *, count(*) FILTER (WHERE q) OVER (PARTITION BY stratum, bin ORDER BY h) AS got FROM p)
SELECT stratum, bin, entry, place::INT AS place, coalesce(q, false) AS taken, CASE WHEN coalesce(q, false) THEN NULL WHEN q IS NULL THEN 'not judged' ELSE 'poor' END AS reason
FROM g WHERE got < 4 OR (q AND got = 4)""")
def draw(spark, sf):
    c = B.campaign(spark, sf).withColumn("bin", S.size_bin(F.col("size")))
    why = F.when(F.col("q").isNull(), "not judged").otherwise("poor")
    return S.stratified_draw(c, "entry", ["stratum", "bin"], "3", 4, F.coalesce("q", F.lit(False)), why)


@query("largest_remainder", "I2", with_(B.CAMP) + """, n AS (SELECT stratum, count(*) AS n FROM camp GROUP BY stratum), s AS (SELECT *, 37 * n / (SELECT sum(n) FROM n)::DOUBLE AS share FROM n),
k AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, stratum) AS k, 37 - (SELECT sum(floor(share)) FROM s) AS spare FROM s)
SELECT stratum, n, greatest(1, floor(share) + CASE WHEN k <= spare THEN 1 ELSE 0 END)::BIGINT AS quota FROM k""")
def quota(spark, sf):
    return S.largest_remainder(B.campaign(spark, sf), "stratum", 37)


@query("draw_quota", "I2", with_(B.CAMP) + """, n AS (SELECT stratum, count(*) AS n FROM camp GROUP BY stratum), s AS (SELECT *, 37 * n / (SELECT sum(n) FROM n)::DOUBLE AS share FROM n),
k AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, stratum) AS k, 37 - (SELECT sum(floor(share)) FROM s) AS spare FROM s),
q AS (SELECT stratum, greatest(1, floor(share) + CASE WHEN k <= spare THEN 1 ELSE 0 END)::BIGINT AS quota FROM k),
p AS (SELECT entry, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('5:' || entry)) AS place FROM camp)
SELECT entry, stratum, place FROM p JOIN q USING (stratum) WHERE place <= quota""")
def drawn(spark, sf):
    c = B.campaign(spark, sf)
    return S.draw_quota(c, "entry", "stratum", S.largest_remainder(c, "stratum", 37), "5").select("entry", "stratum", "place")


@query("group_holdout", "I4", with_(B.CAMP) + """, g AS (SELECT source, count(*) AS n, sha256('9:' || source) AS h FROM camp GROUP BY source), s AS (SELECT source, sum(n) OVER (ORDER BY h) - n AS before FROM g)
SELECT source, count(*) AS entries, before < floor((SELECT count(*) FROM camp) / 3.0 + 1e-9) AS held FROM camp JOIN s USING (source) GROUP BY source, before""")
def holdout(spark, sf):
    h = S.group_holdout(B.campaign(spark, sf), "entry", "source", "9")
    return h.groupBy("source", "held").agg(F.count(F.lit(1)).alias("entries"))


@query("strata_shortfall", "I7", with_(B.CAMP) + """, d AS (SELECT stratum, count(*) FILTER (WHERE q) AS drawn, count(*) AS n FROM camp GROUP BY stratum)
SELECT stratum, (n // 2)::BIGINT AS target, drawn, greatest(n // 2 - drawn, 0)::BIGINT AS short FROM d""")
def shortfall(spark, sf):
    c = B.campaign(spark, sf)
    t = c.groupBy("stratum").agg(F.floor(F.count(F.lit(1)) / 2).cast("bigint").alias("target"))
    return S.strata_shortfall(t, c.filter("q"), "stratum")


@query("pair_states", "I6", with_(B.CAMP) + f""", r AS (SELECT *, {BIN} AS kind, row_number() OVER (PARTITION BY source ORDER BY sha256('2:' || entry)) AS place FROM camp),
j AS (SELECT s.source, s.entry AS seed, s.kind AS kind_a, p.entry AS partner, p.kind AS kind_b, row_number() OVER (PARTITION BY s.source ORDER BY p.place) AS k
 FROM r s JOIN r p ON p.source = s.source AND s.place = 1 AND p.place >= 2 AND p.kind <> s.kind),
w AS (SELECT *, row_number() OVER (PARTITION BY kind_a, kind_b ORDER BY sha256('2:' || seed)) AS place FROM j WHERE k = 1)
SELECT source, seed, kind_a, partner, kind_b, place::INT AS place FROM w""")
def states(spark, sf):
    c = B.campaign(spark, sf).withColumn("kind", S.size_bin(F.col("size")))
    return S.pair_states(c, "source", "entry", "kind", "2")


@query("homology_draw", "I8", with_(B.CAMP) + f""", d AS (SELECT entry AS domain, source AS cluster, stratum || '.' || {BIN} AS superfamily, sha256('4:' || entry) AS h FROM camp),
c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY h) = 1)
SELECT domain, cluster, superfamily FROM c QUALIFY row_number() OVER (PARTITION BY superfamily ORDER BY h) = 1""")
def homology(spark, sf):
    c = B.campaign(spark, sf)
    d = c.select("entry", F.col("entry").alias("domain"), F.col("source").alias("cluster"), F.concat_ws(".", "stratum", S.size_bin(F.col("size"))).alias("superfamily"))
    return S.homology_draw(d, "4").select("domain", "cluster", "superfamily")


# ---------------------------------------------------------------- names and ids
@query("source_id", "K7 K11", with_(B.CAMP) + """, k AS (SELECT entry, CASE stratum WHEN 'en' THEN ' 1ub' || (entry % 10) WHEN 'fr' THEN 'P0' || lpad((entry % 1000)::VARCHAR, 4, '0') || '' WHEN 'de' THEN 'af-p12345-F1' ELSE 'x' || entry END AS raw FROM camp),
u AS (SELECT entry, upper(trim(raw)) AS t FROM k)
SELECT entry, CASE WHEN regexp_matches(t, '^[0-9][A-Z0-9]{3}$') THEN 'pdb' WHEN regexp_matches(t, '^AF-([A-Z0-9]+)-F[0-9]+') THEN 'model'
 WHEN regexp_matches(t, '^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$') THEN 'uniprot' END AS kind,
 CASE WHEN regexp_matches(t, '^[0-9][A-Z0-9]{3}$') OR regexp_matches(t, '^AF-([A-Z0-9]+)-F[0-9]+') OR regexp_matches(t, '^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$') THEN t END AS id,
 nullif(regexp_extract(t, '^AF-([A-Z0-9]+)-F[0-9]+', 1), '') AS accession FROM u""")
def ids(spark, sf):
    e = F.col("entry")
    raw = (
        F.when(F.col("stratum") == "en", F.concat(F.lit(" 1ub"), e % 10)).when(F.col("stratum") == "fr", F.concat(F.lit("P0"), F.lpad((e % 1000).cast("string"), 4, "0")))
        .when(F.col("stratum") == "de", F.lit("af-p12345-F1")).otherwise(F.concat(F.lit("x"), e))
    )
    c = B.campaign(spark, sf).withColumn("raw", raw).withColumn("s", T.source_id(F.col("raw")))
    return c.select("entry", "s.kind", "s.id", T.af_accession(F.trim("raw")).alias("accession"))


@query("wrap_list", "K8", """WITH w AS (SELECT doc_id AS entry, string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ') AS items FROM documents)
SELECT entry, list_aggregate(items[1:5], 'string_agg', ', ') || CASE WHEN len(items) > 5 THEN ' (+' || (len(items) - 5) || ' more)' ELSE '' END AS shown FROM w""")
def wrapped(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("doc_id").alias("entry"), F.split(F.regexp_replace(F.trim("text"), r"\s+", " "), " ").alias("items"))
    return d.select("entry", T.wrap_list(F.col("items"), 5).alias("shown"))


@query("clean_json", "K9", with_(B.CAMP) + """ SELECT entry, '{"judged":' || CASE WHEN q IS NULL THEN 'null' ELSE (q::INT)::VARCHAR || '.0' END || ',"size":' || size || '.0}' AS doc FROM camp""")
def doc(spark, sf):
    c = B.campaign(spark, sf)
    m = F.create_map(F.lit("size"), F.col("size").cast("double"), F.lit("judged"), F.coalesce(F.col("q").cast("double"), F.lit(float("nan"))))
    return c.select("entry", T.clean_json(m).alias("doc"))


@query("feature_label", "K13", """WITH d AS (SELECT doc_id AS entry, coalesce(nullif(CASE WHEN n_chars > 300 THEN text END, ''), nullif(CASE WHEN n_chars > 60 THEN source END, ''), lang) AS t FROM documents)
SELECT entry, CASE WHEN length(t) > 40 THEN substr(t, 1, 38) || '…' ELSE t END AS label FROM d""")
def labels(spark, sf):
    d = B.table(spark, sf, "documents")
    lab = T.feature_label(F.when(F.col("n_chars") > 300, F.col("text")), F.when(F.col("n_chars") > 60, F.col("source")), F.col("lang"))
    return d.select(F.col("doc_id").alias("entry"), lab.alias("label"))
