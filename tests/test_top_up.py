"""Quotas reached by swaps: none broken, and no swap left when short."""

import random
from collections import Counter

from molframe.operators import sampling as S

SAMPLE = "id int, stratum string, bin string, place int, has array<string>, fixed boolean"
REST = "id int, stratum string, bin string, place int, has array<string>"
QUOTAS = [("ligand", 30), ("glycan", 12), ("modified", 10)]


def features(rng, p):
    return [f for f, q in zip(("ligand", "glycan", "modified"), p) if rng.random() < q]


def run(spark, seed, p, q):
    rng = random.Random(seed)
    sample = [(i, f"S{i % 4}", "SM"[i // 4 % 2], i // 4, features(rng, p), i % 9 == 0) for i in range(90)]
    rest = [(1000 + i, f"S{i % 5}", "SM"[i // 5 % 2], i // 5, features(rng, q)) for i in range(600)]
    out = S.top_up(spark.createDataFrame(sample, SAMPLE).repartition(3), spark.createDataFrame(rest, REST).repartition(4), QUOTAS).collect()
    return sample, rest, out


def count(rows, at=4):
    return Counter(f for r in rows for f in r[at])


def test_quotas_are_reached_and_none_is_broken(spark):
    sample, rest, out = run(spark, 1, (0.2, 0.16, 0.13), (0.3, 0.2, 0.2))
    before, after = count(sample), count(out)
    assert before["ligand"] < 30
    for f, t in QUOTAS:
        assert after[f] >= min(t, before[f])
    assert after["ligand"] >= 30 and after["glycan"] >= 12 and after["modified"] >= 10
    # rows keep their place and kind; fixed ones their id; a new one comes from the pool of the one it replaces
    shape = lambda rows: sorted((r[1], r[2], r[3], r[5]) for r in rows)
    assert shape(sample) == shape(out) and len({r.id for r in out}) == len(out)
    ids, pool = {r[0]: r for r in sample}, {r[0]: r for r in rest}
    assert {r[0] for r in sample if r[5]} <= {r.id for r in out}
    assert all(r.id in ids or (r.stratum, r.bin, list(r.has)) == (pool[r.id][1], pool[r.id][2], pool[r.id][4]) for r in out)


def test_ends_only_when_no_swap_is_left(spark):
    # nothing in the pools has a ligand but in a stratum that the sample lacks
    rng = random.Random(3)
    sample = [(i, "S1", "S", i, ["glycan"] if i < 3 else [], False) for i in range(20)]
    rest = [(100 + i, "S1" if i % 3 else "S9", "S", i, ["ligand"] if i % 3 == 0 or i in (4, 7) else features(rng, (0, 0.5, 0.5))) for i in range(60)]
    out = S.top_up(spark.createDataFrame(sample, SAMPLE), spark.createDataFrame(rest, REST), [("ligand", 5), ("glycan", 3)]).collect()
    assert count(out) == {"ligand": 2, "glycan": 3}
    # the last drawn have gone, in order
    assert {r.place for r in out if "ligand" in r.has} == {18, 19}
    assert sorted(r.id for r in out if r.id >= 100) == [104, 107]


def test_surplus_of_another_feature_is_used_and_no_more(spark):
    sample = [(i, "S1", "S", i, ["glycan"], False) for i in range(10)]
    rest = [(100 + i, "S1", "S", i, ["ligand"]) for i in range(10)]
    out = S.top_up(spark.createDataFrame(sample, SAMPLE), spark.createDataFrame(rest, REST), [("ligand", 8), ("glycan", 7)]).collect()
    assert count(out) == {"ligand": 3, "glycan": 7}
