"""The nearest points are looked for in growing reaches, so crowded places and copies make no more pairs than they need."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from molframe.plans import spatial as S


def test_nearest_k_equals_all_pairs_ranked(spark):
    rng = random.Random(6)
    pts = [("e", k, *[round(rng.gauss(0, 1.5), 2) for _ in range(3)]) for k in range(150)]
    pts += [("e", 150 + k, 0.5, 0.5, 0.5) for k in range(9)] + [("e", 200, 40.0, 0.0, 0.0), ("e", 201, 44.0, 0.0, 0.0), ("f", 202, 0.5, 0.5, 0.5)]
    rng.shuffle(pts)
    want = {}
    for p in pts:
        near = sorted((float(np.floor(np.sqrt((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2) * 1000 + 0.5) / 1000), q[1]) for q in pts if q[1] != p[1] and q[0] == p[0])
        want |= {(p[1], n + 1): (q, d) for n, (d, q) in enumerate([x for x in near if x[0] <= 5.0][:2])}
    df = spark.createDataFrame(pts, "entry string, idx int, x double, y double, z double")
    rows = S.nearest_k(df, 5.0, 2).collect()
    assert len(rows) == len(want) and {(r.idx_a, r["rank"]): (r.idx_b, r.distance) for r in rows} == want


def test_copies_of_a_place_do_not_meet_each_other(spark):
    n = 40_000
    p = spark.range(n).select(F.lit("e").alias("entry"), F.col("id").alias("idx"), *[F.lit(1.0).alias(c) for c in "xyz"])
    t = time.time()
    r = S.nearest_k(p, 9.0, 2).groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.max("idx_b").alias("top"), F.max("distance").alias("d")).collect()
    assert {x["rank"]: (x.n, x.top, x.d) for x in r} == {1: (n, 1, 0.0), 2: (n, 2, 0.0)}
    assert time.time() - t < 60  # all pairs: 1.6 billion rows
