"""Distance joins at size: what is copied is not gathered in the driver, two points meet once, costly tests wait for near pairs."""

import itertools
import math
import random
import re

from pyspark.sql import functions as F

from molframe.operators import backbone as K
from molframe.plans import spatial as S


def cloud(spark, n=300):
    rng = random.Random(3)
    rows = [("ef"[i % 2], rng.randrange(10**6) * 1000 + i, *[round(rng.uniform(-9, 9), 3) for _ in range(3)], f"n{i}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "entry string, idx long, x double, y double, z double, name string")


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"Join.*_part#\d+\], \[", line)]


def test_copies_are_never_broadcast_and_costly_tests_stay_above_the_join(spark):
    _, p = cloud(spark)
    for df in (S.pairs_within(p, 3.0), S.pairs_between(p, p, 3.0)):
        assert len(joins(df)) == 1 and "SortMergeJoin" in joins(df)[0]
    at = lambda k: F.struct(*[(F.col(c) + k).alias(c) for c in "xyz"])
    r = p.select("entry", F.col("idx").alias("k"), F.lit("ALA").alias("resname"), at(0.0).alias("ca"), at(1.0).alias("n"), at(2.0).alias("c"), at(3.0).alias("o"), F.lit(True).alias("prev"))
    (line,) = joins(K.hbonds_backbone(r))
    assert "27.888" not in line and "CASE WHEN (least" not in line


def test_each_pair_once_with_the_columns_of_its_own_side(spark):
    rows, p = cloud(spark)
    got = sorted((r.name_a, r.idx_a, r.x_a, r.name_b, r.idx_b, r.x_b) for r in S.pairs_within(p, 3.0, where=F.col("idx_b") - F.col("idx_a") > 5).collect())
    want = []
    for a, b in itertools.combinations(sorted(rows, key=lambda r: r[1]), 2):
        if a[0] == b[0] and math.floor(math.dist(a[2:5], b[2:5]) * 1000 + 0.5) / 1000 <= 3.0 and b[1] - a[1] > 5:
            want.append((a[5], a[1], a[2], b[5], b[1], b[2]))
    assert len(want) > 100 and got == sorted(want)
