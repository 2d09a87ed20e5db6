"""Queries that run a stream over the events to its end and read what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from molframe import bindings as B
from molframe.registry.base import query, with_
from molframe.session import checkpoint_dir
from molframe.streaming import in_order as O
from molframe.streaming import stream as S


def events(spark, sf):
    """The events table as a file stream."""
    schema = B.table(spark, sf, "events").schema
    d = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_dedupe", "L2", "SELECT DISTINCT sha256(user_id || '|' || event_type) AS hash FROM events")
def dedupe(spark, sf):
    return S.run_now(S.stream_dedupe(events(spark, sf), "ts", ["user_id", "event_type"], "60 days")).select("hash")


@query("stream_outcomes", "L3", "SELECT epoch_us(date_trunc('day', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def outcomes(spark, sf):
    out = S.run_now(S.stream_outcomes(events(spark, sf), "ts", "1 day", "60 days", ["event_type"]), "update")
    return S.latest(out, ["start", "event_type"]).select(F.unix_micros("start").alias("start"), "event_type", "n")


@query("stream_sessions", "L5", """WITH f AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 14400000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 14400000000 AS "end", count(*) AS residues FROM g GROUP BY user_id, run""")
def sessions(spark, sf):
    out = S.run_now(S.stream_sessions(events(spark, sf), "ts", "4 hours", "60 days", ["user_id"]), "complete")
    last = S.latest(out, ["user_id", "start"])
    return last.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "residues")


@query("stream_expiring_misses", "L4", """WITH e AS (SELECT user_id AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
w AS (SELECT key, t AS asked, k FROM e WHERE k = 1), n AS (SELECT a.key, a.k, min(b.k) AS nk FROM e a JOIN e b ON b.key = a.key AND b.t - a.t > 86400000000 GROUP BY ALL),
chain(key, k) AS (SELECT key, k FROM w UNION ALL SELECT c.key, n.nk FROM chain c JOIN n ON n.key = c.key AND n.k = c.k)
SELECT key, t AS asked FROM chain JOIN e USING (key, k)""".replace("WITH e", "WITH RECURSIVE e"))
def misses(spark, sf):
    return S.run_now(S.stream_expiring_misses(events(spark, sf), "user_id", "ts", 86400.0)).select("key", "asked")


# ---------------------------------------------------------------- the events as they might arrive: out of order, some late
PARTS, FILES, DELAY = 12, 8, "4 days"


def arriving(spark, sf):
    """The events as a stream of files that come one part of the month after the other. Every seventh event comes a part later,
    which is within DELAY, every fortieth three parts later, which is mostly not. A last file, of an event 90 days on, closes all."""
    e = B.table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    t = F.unix_micros("ts")
    lo, hi = e.agg(F.min(t), F.max(t)).first()
    behind = F.when(F.col("event_id") % 40 == 0, 3).when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    e = e.withColumn("part", F.least(F.lit(PARTS), F.floor((t - lo) * PARTS / (hi - lo + 1)) + behind).cast("int"))
    root = f"{checkpoint_dir(spark).rstrip('/')}/arriving-{uuid.uuid4().hex}"
    e.write.partitionBy("part").parquet(f"{root}/all")
    schema = e.drop("part").schema
    for p in range(PARTS + 1):  # files are taken by the time at which they were written
        spark.read.schema(schema).parquet(f"{root}/all/part={p}").repartition(FILES).write.parquet(f"{root}/in/{p:03d}")
    end = spark.range(1).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"), F.lit("").alias("event_type"), F.timestamp_micros(F.lit(hi + 90 * 86_400_000_000)).alias("ts"))
    end.write.parquet(f"{root}/in/{PARTS + 1:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{root}/in/*")


ARRIVED = with_(
    f"""ar AS (SELECT *, epoch_us(ts) AS t, least({PARTS}, floor((epoch_us(ts) - lo) * {PARTS} / (hi - lo + 1))::BIGINT + CASE WHEN event_id % 40 = 0 THEN 3 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS part
        FROM events, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events))""",
    # the watermark of a batch: four days behind the newest event of the batches before
    "wm AS (SELECT part, (max(max(t)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 - 345600000) * 1000 AS passed FROM ar GROUP BY part)",
    "al AS (SELECT ar.*, coalesce(t < passed, false) AS late, passed FROM ar JOIN wm USING (part))",
)


def _once(key: str, ttl: int) -> str:
    return ARRIVED + f""", e AS (SELECT {key} AS key, t, row_number() OVER (PARTITION BY {key} ORDER BY t) AS k FROM al WHERE NOT late),
n AS (SELECT a.key, a.k, min(b.k) AS nk FROM e a JOIN e b ON b.key = a.key AND b.t - a.t > {ttl} GROUP BY ALL),
chain(key, k) AS (SELECT key, k FROM e WHERE k = 1 UNION ALL SELECT c.key, n.nk FROM chain c JOIN n ON n.key = c.key AND n.k = c.k),
res AS (SELECT key, t, 'taken' AS kind FROM chain JOIN e USING (key, k) UNION ALL SELECT {key}, t, 'late' FROM al WHERE late) """


@query("stream_remembered", "L4", _once("user_id", 86_400_000_000) + "SELECT key, t, kind FROM res")
def remembered(spark, sf):
    return S.run_now(O.remembered(arriving(spark, sf), "user_id", "ts", 86_400.0, DELAY), state=True).filter("key <> -1").select("key", "t", "kind")


@query("stream_content_once", "L2", _once("sha256('=' || user_id || '|=' || event_type)", 432_000_000_000) + "SELECT key AS hash, t, kind FROM res")
def content_once(spark, sf):
    out = S.run_now(O.content_once(arriving(spark, sf), ["user_id", "event_type"], "ts", 432_000.0, DELAY), state=True)
    return out.filter(F.col("hash") != F.sha2(F.lit("=-1|="), 256)).select("hash", "t", "kind")


@query("stream_runs", "L5", ARRIVED + """, f AS (SELECT user_id, t, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w >= 14400000000 THEN 1 ELSE 0 END AS s FROM al WHERE NOT late WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT user_id AS key, min(t) AS start, max(t) + 14400000000 AS "end", count(*) AS residues, 'run' AS kind FROM g GROUP BY user_id, run
UNION ALL SELECT user_id, t, t + 14400000000, 1, 'late' FROM al WHERE late""")
def runs(spark, sf):
    out = S.run_now(O.sessions(arriving(spark, sf), "user_id", "ts", 14_400.0, DELAY), state=True)
    return out.filter("key <> -1").select("key", "start", "end", "residues", "kind")


# a built-in aggregate leaves out rows of windows that the watermark of the batch before last has passed
@query("stream_outcomes_corrected", "L3", ARRIVED + """SELECT epoch_us(date_trunc('day', ts)) AS start, event_type, count(*) AS n
FROM al JOIN (SELECT part, lag(passed) OVER (ORDER BY part) AS before FROM wm) USING (part)
WHERE coalesce(epoch_us(date_trunc('day', ts)) + 86400000000 > before, true) GROUP BY ALL""")
def outcomes_corrected(spark, sf):
    out = S.run_now(S.stream_outcomes(arriving(spark, sf), "ts", "1 day", DELAY, ["event_type"]), "update")
    return S.latest(out, ["start", "event_type"]).filter("event_type <> ''").select(F.unix_micros("start").alias("start"), "event_type", "n")
