"""Backbone hydrogen bonds found block by block are those of comparing every donor with every acceptor."""

import math
import random

import pytest

from molframe.operators import backbone as K

COLS = "entry string, k long, resname string, prev boolean, n struct<x:double,y:double,z:double>, ca struct<x:double,y:double,z:double>, c struct<x:double,y:double,z:double>, o struct<x:double,y:double,z:double>"


def residues(seed, n, wide):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        ca = [round(rng.gauss(0, wide), 3) for _ in range(3)]
        near = lambda s: tuple(round(x + rng.gauss(0, s), 3) for x in ca)  # noqa: E731, B023
        out.append(("ef"[k % 3 == 0], k, "PRO" if k % 17 == 0 else "ALA", k > 2, near(1.0), tuple(ca), near(1.0), near(1.5)))
    return out


def plain(rows):
    found = set()
    for e in "ef":
        mine = [r for r in rows if r[0] == e]
        for b, d in zip([None, *mine], mine):
            if b is None or not d[3] or d[2] == "PRO":
                continue
            way = [p - q for p, q in zip(b[6], b[7])]
            length = math.sqrt(sum(x * x for x in way))
            h = [x + w / length for x, w in zip(d[4], way)]
            some = []
            for a in mine:
                if a[1] in (d[1], d[1] - 1) or math.floor(math.dist(a[5], d[5]) * 1000 + 0.5) / 1000 > 9.0:
                    continue
                on, ch, oh, cn = math.dist(a[7], d[4]), math.dist(a[6], h), math.dist(a[7], h), math.dist(a[6], d[4])
                v = -9.9 if min(on, ch, oh, cn) < 0.5 else max(-9.9, math.floor(27.888 * (1 / on + 1 / ch - 1 / oh - 1 / cn) * 1000 + 0.5) / 1000)
                if v < -0.5:
                    some.append((v, a[1]))
            found |= {(e, k, d[1], v) for v, k in sorted(some)[:2]}
    return found


@pytest.mark.parametrize("crowd", [16384, 30])
def test_the_two_best_of_every_donor(spark, monkeypatch, crowd):
    monkeypatch.setattr(K, "SLICE", (8, 32))
    monkeypatch.setattr(K, "CROWD", crowd)
    rows = [*residues(1, 700, 6.0), *[(e, k + 900, *r) for e, k, *r in residues(2, 60, 60.0)]]
    got = [tuple(r) for r in K.hbonds_backbone(spark.createDataFrame(rows, COLS)).select("entry", "acceptor", "donor", "energy").collect()]
    want = plain(rows)
    assert len(got) == len(set(got)) and set(got) == want
    # many donors have more than two bonds of the least energy, of which the first acceptors count
    assert sum(v == -9.9 for *_, v in want) > 150


def test_a_donor_with_two_bonds_of_the_least_energy_is_not_tried_again(spark, monkeypatch):
    """Every near pair was measured and sent, however many: 64 times as many for eight times the residues of one place."""
    import numpy as np

    n = 20_000
    rng = np.random.default_rng(1)
    at = rng.normal(0, 2.0, (n, 3)).round(3)
    cols = lambda p, v: {p + c: v[:, i] for i, c in enumerate("xyz")}
    a = {"k": np.arange(n), **cols("", at), **cols("c", at + rng.normal(0, 1, (n, 3))), **cols("o", at + rng.normal(0, 1.5, (n, 3)))}
    d = {"k": np.arange(2000), "prev": np.ones(2000, bool), **cols("", at[:2000]), **cols("n", at[:2000] + rng.normal(0, 1, (2000, 3))), **cols("h", at[:2000] + 0.5)}
    tried = []
    nonzero = np.nonzero
    monkeypatch.setattr(K.np, "nonzero", lambda m: tried.append(m.size) or nonzero(m))
    i, j, e = K._two_best(d, a, 9.0, -0.5)
    assert len(i) == 4000 and (e == -9.9).mean() > 0.9
    assert sum(tried) < 2000 * n / 3
