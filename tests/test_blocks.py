"""Points compared block by block: what comes out is what comparing every two points gives, and few rows are sent for it."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from molframe.operators import interactions as I
from molframe.operators import symmetry as S
from molframe.plans import blocks as K

COLS = "entry string, chain string, idx int, x double, y double, z double"


def cloud(seed, n, wide=6.0):
    rng = random.Random(seed)
    # a third of the points lie on borders of blocks, where rounding decides
    at = lambda: float(rng.randrange(-3, 3) * 3) if rng.random() < 0.3 else round(rng.gauss(0, wide), 3)
    return [("ef"[k % 3 == 0], f"c{rng.randrange(7)}", k, at(), at(), at()) for k in range(n)]


def apart(p, q):
    return math.floor(math.sqrt((p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2 + (p[5] - q[5]) ** 2) * 1000 + 0.5) / 1000


@pytest.mark.parametrize("crowd", [65536, 20])
def test_near_pairs_of_units_are_counted_whole(spark, crowd):
    rows = [*cloud(3, 500), ("e", "c0", 900, None, 0.0, 0.0)]
    want = {}
    for p, q in itertools.combinations(rows[:-1], 2):
        if p[0] == q[0] and p[1] != q[1] and apart(p, q) <= 3.0:
            k = (p[0], *sorted((p[1], q[1])))
            want[k] = want.get(k, 0) + 1
    got = K.near_pair_counts(spark.createDataFrame(rows, COLS), 3.0, "chain", crowd=crowd).collect()
    assert len(want) > 30 and {(g.entry, g.chain_a, g.chain_b): g.pairs for g in got} == want and len(got) == len(want)


def test_a_point_is_sent_to_the_blocks_it_may_reach_and_no_others(spark):
    rng = random.Random(1)
    p = spark.createDataFrame([("e", "c", k, *[rng.uniform(-60, 60) for _ in range(3)]) for k in range(2000)], COLS)
    sent, _ = K._dealt(p, 3.0, ["entry"], "idx", 65536)
    # once as one that stays, and on average to 4.5 blocks; all of 14 before
    assert 2000 * 5.2 < sent.count() < 2000 * 5.8
    assert sent.filter("_stay").count() == 2000 and sent.filter("not _stay and _own").count() == 2000


def test_protomers_join_no_residues_by_distance(spark, monkeypatch):
    """Counts of contacts between chains were aggregated from a row for every near pair, and worked out once for each direction."""
    calls = []
    count = S.near_pair_counts
    monkeypatch.setattr(S, "near_pair_counts", lambda *a, **b: calls.append(1) or count(*a, **b))
    rows = []
    for part, names in enumerate(("AB", "ab")):
        for k, c in enumerate(names):
            rows += [("e", c, 1000 * (2 * part + k) + i, (9.0 + i % 5) * (1 - 2 * k), 3.0 + i % 3, part * 4.0 + i % 4) for i in range(12)]
    copies = [("e", c, c if c in "Aa" else "Aa"["Bb".index(c)], 0) for c in "ABab"]
    turns = [("e", "A", "B"), ("e", "B", "A"), ("e", "a", "b"), ("e", "b", "a")]
    found = S.Cyclic(spark.createDataFrame([("e", 2)], "entry string, n int"), spark.createDataFrame(turns, "entry string, chain string, to string"), None)
    got = S.protomers(spark.createDataFrame(rows, COLS), spark.createDataFrame(copies, "entry string, chain string, first string, shift int"), found)
    got = got.groupBy("protomer").agg(F.array_join(F.array_sort(F.collect_list("chain")), "").alias("g")).collect()
    assert sorted(g.g for g in got) == ["Aa", "Bb"] and calls == [1]


@pytest.mark.parametrize("crowd", [65536, 20])
def test_near_pairs_that_pass_a_coarse_test_come_once(spark, crowd):
    rows = cloud(5, 300)
    p = spark.createDataFrame(rows, COLS).withColumn("odd", F.col("idx") % 2 == 1)
    may = lambda column: abs(column("x")[0] - column("x")[1]) <= 1.5
    got = [(g.entry, g.idx_a, g.idx_b, g.chain_a, g.chain_b) for g in K.near_pairs_that(p, 3.0, may, ["x"], "odd", crowd=crowd).filter(S.snap(F.sqrt(sum((F.col(c + "_a") - F.col(c + "_b")) ** 2 for c in "xyz"))) <= 3.0).collect()]
    both = [(p, q) for p, q in itertools.combinations(rows, 2) if p[0] == q[0] and not (p[2] % 2 and q[2] % 2)]
    want = [(p[0], p[2], q[2], p[1], q[1]) for p, q in both if apart(p, q) <= 3.0 and abs(p[3] - q[3]) <= 1.5]
    assert len(want) > 100 and sorted(got) == sorted(want)


def test_only_rings_that_may_stack_become_rows(spark):
    """Every near pair of rings was a row of the join, before its angle and offset were looked at."""
    rng = random.Random(2)
    names = ("CG", "CD1", "CD2", "CE1", "CE2", "CZ")
    rows = [("e", "AB"[k % 2], k, "", "PHE", n, "C", 8 * k + i, *[round(rng.gauss(0, 2), 3) for _ in range(3)]) for k in range(60) for i, n in enumerate(names)]
    atoms = spark.createDataFrame(rows, "entry string, chain string, seq int, icode string, resname string, atom string, elem string, idx int, x double, y double, z double")
    d = I.pi_stacking(atoms, "interchain")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert d.count() > 20 and "FlatMapGroupsInArrow" in plan and "Join" not in plan
