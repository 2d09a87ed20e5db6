"""Steps that grew faster than their input: each is held against a plain count on an input that the former step could not do in time."""

import itertools
import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from molframe.operators import chain_scores as C
from molframe.operators import domains as D
from molframe.operators import msa
from molframe.operators import nucleic as N
from molframe.registry import load


def test_one_letter_takes_long_texts_in_one_pass(spark, tmp_path):
    n = 400_000
    text = "ala" * n + "thr" * n + "xyz" * 7 + "al"
    spark.createDataFrame([(1, text, "en", "s"), (2, None, "en", "s"), (3, "ab", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    t = time.time()
    got = [(r.row, r.residues, r.unknown, r.threonines) for r in load()["one_letter"].run(spark, str(tmp_path)).collect()]
    assert got == [(1, 2 * n + 7, 7, n)]
    assert time.time() - t < 60  # places counted from the beginning of the text: minutes


def test_rings_of_four_go_through_lesser_nodes(spark):
    rng = random.Random(2)
    e = {(a, b) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(90)) if a != b}
    want = {tuple(sorted(r)) for r in itertools.permutations(range(14), 4) if all((r[i], r[(i + 1) % 4]) in e for i in range(4))}
    got = [tuple(r.ring) for r in N.rings_of_four(spark.createDataFrame(sorted(e), "a int, b int"), []).collect()]
    assert len(want) > 30 and len(got) == len(want) and set(got) == want
    # a hub that 20,000 nodes give to and that gives to 20,000 others: 200 million walks of two steps if it is entered by the others
    n = 20_000
    hub = spark.range(2 * n).select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.lit(10**9)).alias("a"), F.when(F.col("id") % 2 == 0, F.lit(10**9)).otherwise(F.col("id")).alias("b"))
    ring = spark.createDataFrame([(10**9, 2), (2, 10**9 + 1), (10**9 + 1, 1), (1, 10**9)], "a long, b long")
    t = time.time()
    assert [tuple(r.ring) for r in N.rings_of_four(hub.unionByName(ring), []).collect()] == [(1, 2, 10**9, 10**9 + 1)]
    assert time.time() - t < 60


def test_lowest_cut_equals_all_runs_tried():
    rng = np.random.default_rng(5)
    for m, least, piece in [(12, 3, 2), (14, 4, 3), (9, 2, 1)]:
        w = np.triu(rng.integers(0, 4, (m, m)) * (rng.random((m, m)) < 0.4))
        w[: m // 2, m // 2 :] //= 2
        total = 2 * int(w.sum())

        def value(inside):
            vol = sum(int(w[p, q]) for p in range(m) for q in range(m) for end in (p, q) if end in inside)
            across = sum(int(w[p, q]) for p in range(m) for q in range(m) if (p in inside) != (q in inside))
            return math.floor((across / vol + across / (total - vol)) * 1e9 + 0.5) / 1e9 if vol and total - vol else None

        ends = lambda x, lo, hi: x in (lo, hi) or (x - lo >= piece and hi - x >= piece)
        runs = [(i, j) for i in range(m) for j in range(i + piece, m + 1) if (i == 0 or i >= piece) and (j == m or m - j >= piece)]
        one = [(value(set(range(*r))), *r) for r in runs if least <= r[1] - r[0] <= m - least]
        v, a, b = min(k for k in one if k[0] is not None)
        two = [(value({*range(a, b), *range(c, d)}), c, d) for c, d in runs if m - (b - a) - (d - c) >= least and ((d <= a and ends(d, 0, a)) or (c >= b and ends(c, b, m)))]
        less = [k for k in two if k[0] is not None and k[0] < v]
        want = (min(less)[0], a, b, *min(less)[1:]) if less else (v, a, b, None, None)
        assert D.lowest_cut(w, least, piece) == want


def test_a_cloud_without_domains_is_cut_in_one_pass(spark):
    rng = random.Random(8)
    rows = [("e", c, k, *[rng.uniform(-14, 14) for _ in range(3)]) for c in "AB" for k in range(200)]
    rows.append(("e", "C", 0, 0.0, 0.0, 0.0))  # a chain without contacts
    df = spark.createDataFrame(rows, "entry string, chain string, pos bigint, x double, y double, z double")
    t = time.time()
    d, cuts = D.residue_domains(df, limit=1.2, least=12, piece=6)
    got = d.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("domain").alias("k"), F.max("domain").alias("top")).collect()
    made = {r.chain: r.n for r in cuts.groupBy("chain").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.chain: r.n for r in got} == {"A": 200, "B": 200, "C": 1} and made["A"] > 3
    assert all(r.k == made.get(r.chain, 0) + 1 == r.top + 1 for r in got)
    assert time.time() - t < 40  # round by round with a table of runs each: minutes


def test_selections_are_measured_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = rng.uniform(-9, 9, (23, 6)).round(3)
    pts = spark.createDataFrame([("p", k, *map(float, r)) for k, r in enumerate(p)], "pair string, idx int, x double, y double, z double, u double, v double, w double")
    pts = pts.withColumn("g1", F.xxhash64("idx")).withColumn("g2", F.xxhash64(F.lit(7), "idx"))
    monkeypatch.setattr(C, "TILE", 5)
    blocks = C._tiles(pts, ["idx", *"xyzuvw", "g1", "g2"], "points", F.floor(F.col("idx") / C.TILE))
    fits = [("p", (s, k), 7.0, 3.0, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, -1.0, 0.0], (0.5, 0.0, float(k))) for s, k in [(23, 0), (4, 0), (4, 7), (5, 9), (6, 11), (7, 3), (8, 2), (9, 1)]]
    got = {r.start.low: r for r in C.measured(spark.createDataFrame(fits, "pair string, start struct<size:int,low:int>, near double, scale double, r array<double>, t struct<x:double,y:double,z:double>"), blocks).collect() if r.start.size != 23}
    assert len(got) == 7
    for k, r in got.items():
        d = np.floor(np.linalg.norm(p[:, :3] @ np.array([[1, 0, 0], [0, 0, -1], [0, 1, 0]]) + [0.5, 0, k] - p[:, 3:], axis=1) * 1024 + 0.5) / 1024
        on = d < 7.0
        assert (r["all"], r.n) == (23, on.sum()) and np.allclose(r.small, np.sort(d)[:3])
        assert np.isclose(r.s_xv, (p[on, 0] * p[on, 4]).sum()) and np.isclose(r.s_z, p[on, 2].sum())


def test_blocks_of_a_long_text_are_cut_in_one_pass(spark):
    n = msa.BLOCK * 4000 + 5
    s = spark.range(1).select(F.lit("f").alias("family"), F.col("id").alias("row"), F.repeat(F.lit("AB\nDE"), n // 5).alias("seq")).unionByName(
        spark.createDataFrame([("f", 1, ""), ("f", 2, None), ("f", 3, "A" * msa.BLOCK)], "family string, row long, seq string"))
    b = msa.blocks(s)
    assert "substring" not in b._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.row, r.block): r.piece for r in b.filter("block < 2 or block >= 3999").collect()}
    text = ("AB\nDE" * (n // 5)).encode()
    want = {(0, k): text[k * msa.BLOCK : (k + 1) * msa.BLOCK] for k in (0, 1, 3999, 4000) if k * msa.BLOCK < len(text)}
    assert {k: bytes(v) for k, v in got.items()} == want | {(3, 0): b"A" * msa.BLOCK}
