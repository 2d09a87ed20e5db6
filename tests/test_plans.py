"""The shared plans against brute force on small random data, hot groups among it."""

import itertools
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from molframe.operators import nucleic as N
from molframe.plans import graph as G
from molframe.plans import intervals as V
from molframe.plans import ranks as R
from molframe.plans import spatial as S
from molframe.plans.ordered import Ordered, block_of
from molframe.plans.rounds import match_one_to_one


def test_pairs_with_a_crowded_cell(spark):
    rng = random.Random(5)
    pts = [(0, k, rng.uniform(0, 2) if k < 120 else rng.uniform(-30, 30), rng.uniform(0, 2), rng.uniform(0, 2)) for k in range(240)]
    df = spark.createDataFrame(pts, "entry int, idx int, x double, y double, z double")
    old, S.CROWD = S.CROWD, 40
    try:
        a = S._side(df, ["entry"], ["x", "y", "z"], "_a", 3.0, ["_cx", "_cy", "_cz"])
        b = S._side(df, ["entry"], ["x", "y", "z"], "_b", 3.0, ["_cx", "_cy", "_cz"])
        j = S.grid_join(a, b, ["entry"], ["_cx", "_cy", "_cz"], 3, "idx_b", crowd=40)
        got = {(r.idx_a, r.idx_b) for r in j.withColumn("d", S.separation(["x", "y", "z"], "_a", "_b")).filter("d <= 3 and idx_a < idx_b").collect()}
    finally:
        S.CROWD = old
    want = {(p[1], q[1]) for p, q in itertools.combinations(pts, 2) if math.dist(p[2:], q[2:]) <= 3}
    assert got == want


def test_ordered_steps_across_blocks(spark):
    rng = random.Random(2)
    rows = [(k % 2, i, rng.choice("ab"), rng.choice([None, i])) for k in range(2) for i in range(60) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "key int, pos int, code string, lab int").repartition(5)
    o = Ordered(df, ["key"], ["pos"], block_of(F.col("pos"), 7)).neighbour(["code"], "prev_").row_number("n").carry(F.col("lab"), "last").carry(F.col("lab"), "next", ahead=True)
    got = {(r.key, r.pos): (r.prev_code, r.n, r.last, r.next) for r in o.done().collect()}
    for key in (0, 1):
        mine = sorted(r for r in rows if r[0] == key)
        for n, r in enumerate(mine):
            back = [x[3] for x in mine[: n + 1] if x[3] is not None]
            ahead = [x[3] for x in mine[n:] if x[3] is not None]
            assert got[(key, r[1])] == (mine[n - 1][2] if n else None, n + 1, back[-1] if back else None, ahead[0] if ahead else None)


def test_quantiles_and_auc(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else "cold", round(rng.uniform(0, 50), 2), rng.random() < 0.4) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, v double, r boolean")
    q = {r.g: r for r in R.quantiles(df, ["g"], "v", {"q1": 0.25, "med": 0.5}).collect()}
    for g in ("hot", "cold"):
        vs = sorted(v for k, v, _ in rows if k == g)
        at = 0.25 * (len(vs) - 1)
        want = vs[int(at)] + (vs[math.ceil(at)] - vs[int(at)]) * (at - int(at))
        assert abs(q[g].q1 - want) < 1e-9 and q[g].n == len(vs)
    a = R.auc(df, [], "v", F.col("r")).first()
    pos, neg = [v for _, v, r in rows if r], [v for _, v, r in rows if not r]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(a.auc - want) < 1e-9


def test_greedy_matching_is_the_sequential_one(spark):
    rng = random.Random(11)
    cand = list({(0, rng.randrange(12), rng.randrange(12)): None for _ in range(60)})
    w = {c: rng.randrange(5) for c in cand}
    df = spark.createDataFrame([(*c, w[c]) for c in cand], "g int, a int, b int, w int")
    got = {(r.a, r.b) for r in match_one_to_one(df, ["g"], "a", "b", [-F.col("w"), F.col("a"), F.col("b")]).collect()}
    want, ua, ub = set(), set(), set()
    for g, a, b in sorted(cand, key=lambda c: (-w[c], c[1], c[2])):
        if a not in ua and b not in ub:
            want.add((a, b)), ua.add(a), ub.add(b)
    assert got == want


def test_forest_track_and_walk(spark):
    edges = [(0, "a", "b", 5), (0, "b", "c", 4), (0, "c", "d", 3), (0, "a", "d", 1), (0, "c", "x", 2), (1, "p", "q", 1)]
    df = spark.createDataFrame(edges, "entry int, a string, b string, w int")
    t = G.max_spanning_forest(df, ["entry"], "a", "b", "w")
    assert t.count() == 5 and t.agg(F.sum("weight")).first()[0] == 15
    on, off = G.tree_track(t, ["entry"], "a", "b")
    one = sorted((r.place, r.node) for r in on.filter("entry = 0").collect())
    assert len(one) == 4 and [(r.node, r.parent) for r in off.collect()][0][1] == "c"
    assert {r.component: r.closed for r in G.cyclic_flag(df, ["entry"], "a", "b").collect()} == {"a": True, "p": False}


def test_intervals(spark):
    spans = [(0, 1, 5, 200), (0, 2, 150, 160), (1, 3, 5, 6)]
    pts = [(0, 5), (0, 155), (0, 201), (1, 6)]
    s = spark.createDataFrame(spans, "key int, id int, first int, last int")
    p = spark.createDataFrame(pts, "key int, pos int")
    got = sorted((r.key, r.pos, r.id) for r in V.points_in(p, s, ["key"], "pos", "first", "last").collect())
    assert got == [(0, 5, 1), (0, 155, 1), (0, 155, 2), (1, 6, 3)]


def test_stems_knots_levels_and_runs(spark):
    # ((..[[..))..]] : two stems that cross
    pairs = [(0, 1, 10, 1, 1), (0, 2, 9, 1, 1), (0, 5, 14, 1, 1), (0, 6, 13, 1, 1)]
    df = spark.createDataFrame(pairs, "entry int, i int, j int, strand_a int, strand_b int")
    st = N.stems(df, ["entry"]).withColumn("rank", -F.col("pairs"))
    assert sorted((r.i, r.stem, r.pairs) for r in st.collect()) == [(1, 1, 2), (2, 1, 2), (5, 2, 2), (6, 2, 2)]
    lev = {r.stem: r.level for r in N.pair_levels(st.withColumn("tie_", F.col("stem")), ["entry"], "stem", ["rank", "tie_"]).collect()}
    assert lev == {1: 0, 2: 1}
    kept = {r.stem: r.kept for r in N.pseudoknots(st.withColumn("tie_", F.col("stem")), ["entry"], "stem", ["rank", "tie_"]).collect()}
    assert kept == {1: True, 2: False}
    places = spark.createDataFrame([(0, 1, k) for k in range(0, 16)], "entry int, strand int, pos int")
    nested = st.filter("stem = 1").select("entry", "i", "j")
    runs = {(r.lo, r.hi): r.kind for r in N.na_runs(places, nested, ["entry"]).collect()}
    assert runs == {(0, 0): "tail", (3, 8): "hairpin", (11, 15): "tail"}


def test_bins_are_even_whatever_the_values(spark):
    n = 20_000
    rng = np.random.default_rng(4)
    skewed = {"even": np.arange(n) / 7.0, "outlier": np.append(np.arange(n - 1) * 1e-3, 1e12), "heavy": np.where(rng.random(n) < 0.9, 5.0, np.exp(rng.normal(0, 5, n))), "one": np.full(n, 3.0)}
    d = spark.createDataFrame(pd.concat([pd.DataFrame({"g": g, "x": v}) for g, v in skewed.items()]))
    counts = R.value_counts(d, ["g"], "x").cache()
    sizes = {g: [r["count"] for r in R.binned(counts, ["g"], 64).filter(F.col("g") == g).groupBy("_bin").count().collect()] for g in skewed}
    for g in ("even", "outlier", "heavy"):
        assert 40 <= len(sizes[g]) <= 64 and max(sizes[g]) <= 2 * np.median(sizes[g])
    got = {r.g: r for r in R.quantiles(d, ["g"], "x", {"q1": 0.25, "median": 0.5, "p99": 0.99, "most": 1.0}).collect()}
    for g, v in skewed.items():
        want = np.quantile(v, [0.25, 0.5, 0.99, 1.0])
        assert got[g].n == n and np.allclose([got[g].q1, got[g].median, got[g].p99, got[g].most], want, rtol=1e-12)
    (whole,) = R.quantiles(d.filter("g = 'even'"), [], "x", {"median": 0.5}).collect()
    assert abs(whole["median"] - np.median(skewed["even"])) < 1e-9
    assert R.quantiles(d.filter("g = 'none'"), ["g"], "x", {"median": 0.5}).count() == 0
