"""Queries on the alignment binding: whole document texts as aligned rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from molframe import bindings as B
from molframe.functions.chemistry import SIMILAR
from molframe.functions.geom import snap
from molframe.functions.text import ONE_LETTER, one_letter
from molframe.operators import msa
from molframe.registry.base import query, with_
from molframe.registry.points_q import rsnap

COUNTS = """cnt AS (SELECT family, col, letter, count(*) AS c FROM aln GROUP BY ALL), fam AS (SELECT family, count(*) AS rows FROM seqs GROUP BY family)"""
GROUPED = "greatest(" + ", ".join("sum(CASE WHEN letter IN (" + ", ".join(f"'{x}'" for x in g) + ") THEN c ELSE 0 END)" for g in SIMILAR) + ")"


@query("column_classes", "D6", with_(B.SEQ, COUNTS) + f""", k AS (SELECT family, col, sum(c)::BIGINT AS present, count(*) AS types, max(c) AS top, {GROUPED} AS grp FROM cnt GROUP BY ALL)
SELECT family, col, present, types, (present = rows AND types = 1) AS strict, NOT (present = rows AND types = 1) AND greatest(top, grp) / rows::DOUBLE >= 0.7 AS similar FROM k JOIN fam USING (family)""")
def classes(spark, sf):
    return msa.column_classes(B.letters(spark, sf))


W = """typ AS (SELECT family, col, count(*) AS types FROM cnt GROUP BY ALL),
wr AS (SELECT a.family, a.row, sum(1.0::DOUBLE / (types * c)) AS w FROM aln a JOIN cnt USING (family, col, letter) JOIN typ USING (family, col) GROUP BY ALL),
wt AS (SELECT family, sum(w) AS total FROM wr GROUP BY family),
wgt AS (SELECT s.family, s.row, CASE WHEN total > 0 THEN coalesce(w, 0.0) / total ELSE 1.0 / rows END AS weight FROM seqs s
  LEFT JOIN wr ON wr.family = s.family AND wr.row = s.row JOIN fam ON fam.family = s.family LEFT JOIN wt ON wt.family = s.family)"""


@query("henikoff_weights", "D7", with_(B.SEQ, COUNTS, W) + f" SELECT family, row, {rsnap('weight', 1000000)} AS weight FROM wgt")
def weights(spark, sf):
    return msa.henikoff_weights(B.letters(spark, sf)).select("family", "row", snap(F.col("weight"), 1e6).alias("weight"))


@query("conservation", "D8 K12", with_(B.SEQ, COUNTS, W) + f""", m AS (SELECT family, col, letter, sum(weight) AS m FROM aln JOIN wgt USING (family, row) GROUP BY ALL),
p AS (SELECT family, col, sum(m) AS present, sum(m * ln(m)) AS s FROM m WHERE m > 0 GROUP BY ALL)
SELECT family, col, {rsnap(f'least(1.0, greatest(0.0, (1.0 - (ln(present) - s / present) / {math.log(20)!r}) * present))')} AS conservation FROM p""")
def conservation(spark, sf):
    return msa.conservation(B.letters(spark, sf)).select("family", "col", snap(F.col("conservation")).alias("conservation"))


@query("one_letter", "K2", with_(B.SEQ) + ", codes(name, one) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ONE_LETTER.items()) + """),
 t AS (SELECT row, substr(seq, 3 * i + 1, 3) AS name FROM (SELECT row, seq, unnest(range((len(seq) // 3)::BIGINT)) AS i FROM seqs))
SELECT row, count(*) AS residues, count(*) FILTER (WHERE one IS NULL) AS unknown, count(*) FILTER (WHERE one = 'T') AS threonines FROM t LEFT JOIN codes USING (name) GROUP BY row""")
def letters(spark, sf):
    s = B.letters(spark, sf)
    # one pass over the text: a substring is counted from its beginning each time
    t = s.select("row", F.explode(F.regexp_extract_all("seq", F.lit("(...)"), F.lit(1))).alias("name"))
    one = one_letter(F.col("name"))
    return t.groupBy("row").agg(F.count(F.lit(1)).alias("residues"), F.count_if(one == "X").alias("unknown"), F.count_if(one == "T").alias("threonines"))
