"""Stems as formulas: a straight duplex, one with a kink, a curved one, and one with a bulge."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from molframe.operators import stem_axis as S

PAIR = "entry long, stem long, i long, j long, a struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>"
POINT = "entry long, pos long, p struct<x:double,y:double,z:double>"


def turn_y(deg):
    t = math.radians(deg)
    return np.array([[math.cos(t), 0, math.sin(t)], [0, 1, 0], [-math.sin(t), 0, math.cos(t)]])


def duplex(n, direction, entry=1, stem=1, skip=()):
    """Pairs and phosphates of n pairs, 36 degrees and 3.4 along the axis apart; `direction(k)` turns the axis at pair k.
    After the pairs in `skip` the first arm has one nucleotide more."""
    pairs, points, at, i = [], [], np.zeros(3), 10
    for k in range(n):
        r = direction(k)
        place = lambda deg, radius: at + r @ np.array([radius * math.cos(math.radians(36 * k + deg)), radius * math.sin(math.radians(36 * k + deg)), 0.0])
        snap = lambda v: tuple(round(float(x), 3) for x in v)
        pairs.append((entry, stem, i, 1000 - k, snap(place(0, 5.5)), snap(place(150, 5.5))))
        points += [(entry, i, snap(place(-20, 9.0))), (entry, 1000 - k, snap(place(170, 9.0)))]
        i += 1
        if k in skip:
            points.append((entry, i, snap(place(10, 9.0))))
            i += 1
        at = at + r @ np.array([0, 0, 3.4])
    return pairs, points


def run(spark, pairs, points, seed=1, parts=3, most=S.TURN):
    random.Random(seed).shuffle(pairs)
    p = spark.createDataFrame(pairs, PAIR).repartition(parts)
    return S.stem_pieces(p, spark.createDataFrame(points, POINT).repartition(parts), ["entry"], most).cache()


def brute(pairs, points, most=25.0):
    """The rule pair by pair."""
    pairs = sorted(pairs, key=lambda p: p[2])
    a, b = np.array([p[4] for p in pairs]), np.array([p[5] for p in pairs])
    mid, n = (a + b) / 2, len(pairs)
    across = lambda lo, hi: np.linalg.svd(b[lo:hi] - a[lo:hi])[2][2]
    along = lambda v, lo, hi: v if (mid[hi - 1] - mid[lo]) @ v >= 0 else -v
    cuts = [0]
    if n >= 10:
        w = min(11, max(5, n // 2))
        lows = [min(max(0, k - w // 2), n - w) for k in range(n)]
        ax = np.array([along(across(lo, lo + w), lo, lo + w) for lo in lows])
        for k in range(1, n):
            plain = pairs[k][2] == pairs[k - 1][2] + 1 and pairs[k][3] == pairs[k - 1][3] - 1
            turned = math.degrees(math.acos(max(-1, min(1, ax[k] @ ax[cuts[-1]]))))
            if plain and turned > most and k - cuts[-1] >= 5:
                cuts.append(k)
        if len(cuts) > 1 and n - cuts[-1] < 5:
            cuts.pop()
    where = {p[1]: np.array(p[2]) for p in points}
    out = []
    for lo, hi in zip(cuts, cuts[1:] + [n]):
        axis = across(lo, hi)
        if hi - lo >= 11:
            pos = [*range(pairs[lo][2], pairs[hi - 1][2] + 1), *range(pairs[hi - 1][3], pairs[lo][3] + 1)]
            q = np.array([where[x] for x in pos])
            axis = np.linalg.svd(q - q.mean(axis=0))[2][0]
        out.append((lo, hi - 1, along(axis, lo, hi)))
    return out


def check(spark, pairs, points, most=S.TURN):
    want = brute(pairs, points, most)
    got = run(spark, list(pairs), points, most=most).orderBy("piece").collect()
    assert [(r.lo, r.hi) for r in got] == [(lo, hi) for lo, hi, _ in want]
    for r, (_, _, axis) in zip(got, want):
        assert np.allclose([r.axis.x, r.axis.y, r.axis.z], axis, atol=2e-3)
    return got


def test_an_ideal_duplex_is_one_piece_without_bend(spark):
    pairs, points = duplex(30, lambda k: np.eye(3))
    (one,) = check(spark, pairs, points)
    assert abs(one.axis.z) > 0.999 and (one.i0, one.i1, one.j1, one.j0) == (10, 39, 971, 1000)
    (b,) = S.stem_bends(run(spark, pairs, points), ["entry"]).collect()
    assert (b.pieces, b.straight, b.bend, b.pairs) == (1, True, 0.0, 30)


def test_a_kinked_duplex_gives_two_pieces_and_its_angle(spark):
    pairs, points = duplex(40, lambda k: turn_y(0 if k < 20 else 50))
    got = check(spark, pairs, points)
    assert len(got) == 2
    (b,) = S.stem_bends(run(spark, pairs, points), ["entry"]).collect()
    assert b.pieces == 2 and abs(b.bend - 50) < 6 and not b.straight


def test_a_curved_duplex_is_cut_again_and_again(spark):
    pairs, points = duplex(90, lambda k: turn_y(3.0 * k))
    got = check(spark, pairs, points)
    assert len(got) > 6
    assert len(check(spark, pairs, points, most=10.0)) > len(got)


def test_cuts_fall_on_plain_steps_only(spark):
    pairs, points = duplex(40, lambda k: turn_y(0 if k < 20 else 60), skip=range(15, 24))
    check(spark, pairs, points)


@pytest.mark.parametrize("n", [1, 2, 4, 9, 10, 14])
def test_short_stems(spark, n):
    pairs, points = duplex(n, lambda k: turn_y(12.0 * k))
    got = run(spark, list(pairs), points).orderBy("piece").collect()
    if n == 1:
        assert got[0].axis is None and got[0].pairs == 1
    elif n > 3:
        check(spark, pairs, points)


def test_row_order_partitions_blocks_and_many_stems_change_nothing(spark):
    a, pa = duplex(60, lambda k: turn_y(2.5 * k), entry=1, stem=1)
    b, pb = duplex(25, lambda k: np.eye(3), entry=2, stem=1)
    rows = lambda d: sorted((r.entry, r.stem, r.piece, r.lo, r.hi, r.axis, r.centre) for r in d.collect())
    want = rows(run(spark, a + b, pa + pb))
    assert rows(run(spark, a + b, pa + pb, seed=9, parts=7)) == want
    assert rows(run(spark, list(a), pa)) == [r for r in want if r[0] == 1]
    places = S.local_axes(S.stem_places(spark.createDataFrame(a, PAIR), ["entry"]), ["entry"]).cache()
    cuts = lambda size: sorted(r.cut for r in S.turn_cuts(places, ["entry"], block=size).collect())
    assert cuts(4096) == cuts(7) == cuts(1) and len(cuts(4096)) > 3


def test_names_of_pieces(spark):
    d = spark.createDataFrame([("P2", 0), ("P2", 26), ("P2a", 0), ("DNA 1", 1)], "name string, k int")
    assert [r[0] for r in d.select(S.piece_name(F.col("name"), F.col("k"))).collect()] == ["P2a", "P2aa", "P2a1", "DNA 1b"]


def test_no_pairs(spark):
    assert run(spark, [], []).collect() == []
