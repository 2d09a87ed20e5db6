"""Base-pair candidates: bases are told apart before they meet, planes and sides decide before bonds are measured."""

import math
import random
import re

from molframe.functions import chemistry as chem
from molframe.operators import nucleic as N

ATOMS = ["N1", "N2", "N3", "N4", "N6", "O2", "O4", "O6"]


def test_candidates_equal_a_plain_search(spark):
    rng = random.Random(3)
    p = lambda w: tuple(round(rng.gauss(0, w), 3) for _ in range(3))
    rows = []
    for k in range(200):
        c1 = p(6)
        at = {a: tuple(c + d for c, d in zip(c1, p(3))) for a in ATOMS if rng.random() < 0.9}
        rows.append(("e", "AB"[k % 2], 1, k, k * 7 % 200, "ACGUITX"[k % 7] if k % 11 else None, at, k % 5 == 0, p(1) if k % 6 else None, p(1), c1))
    v = "struct<x:double,y:double,z:double>"
    nts = spark.createDataFrame(rows, f"entry string, chain string, strand int, pos int, idx int, base string, at map<string,{v}>, turned boolean, normal {v}, gly {v}, c1 {v}")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    want = {}
    for a in rows:
        for b in rows:
            r = next((r for r in chem.BASE_PAIRS if (r[0], r[1]) == (a[5], b[5])), None)
            far = math.floor(math.dist(a[10], b[10]) * 1000 + 0.5) / 1000
            if r is None or not 9 <= far <= 12 or (a[1] == b[1] and abs(a[3] - b[3]) <= 3):
                continue
            name = lambda q: {"O4": "O2", "O2": "O4"}.get(q, q) if b[7] else q
            bonds = sorted(math.dist(a[6][x], b[6][name(y)]) for x, y in r[2] if x in a[6] and name(y) in b[6])
            found = [d for d in bonds if d <= 12.0]
            loose = len(bonds) >= r[3] and bonds[r[3] - 2] <= 12.0 and bonds[r[3] - 1] <= 13.0
            u = tuple(y - x for x, y in zip(a[10], b[10]))
            n, m = cross(a[9], u), cross(u, b[9])
            flat = a[8] is None or b[8] is None or abs(dot(a[8], b[8])) >= math.sqrt(0.5)
            if (len(found) >= r[3] or loose) and flat and dot(n, m) < -0.5 * math.hypot(*n) * math.hypot(*m):
                held = found if len(found) >= r[3] else [d for d in bonds if d <= 13.0]
                one, two = sorted((a, b), key=lambda s: s[4])
                want[one[4], two[4]] = (one[1], one[3], two[1], two[3], r[4], len(held), round(sum(held) / len(held), 6), len(found) >= r[3])
    d = N.base_pair_candidates(nts, 12.0, 13.0)
    got = {(r.idx_a, r.idx_b): (r.chain_a, r.pos_a, r.chain_b, r.pos_b, r.kind, r.held, round(r["mean"], 6), r.tight) for r in d.collect()}
    assert len(want) > 20 and got == want
    # no pair carries the atoms of its bases by name
    assert not re.search(r"\bat_[ab]\b", d._jdf.queryExecution().optimizedPlan().toString())
