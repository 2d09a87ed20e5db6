"""Registers are looked for only in strand pairs with enough bridges, of both structures in one pass."""

import random
from collections import defaultdict

from molframe.operators import compare as K


def test_pairings_of_two_structures_in_one_pass(spark):
    rng = random.Random(5)
    strands = [("e", s, 10 * s, 10 * s + 7) for s in range(6)]
    rows = sorted({("e", rng.randrange(60), rng.randrange(60), rng.choice("PA"), rng.choice("FO")) for _ in range(240)})
    rows += [("e", 2, 12, "P", "F"), ("e", 3, 17, "A", "O")]
    held = defaultdict(list)
    for _, i, j, k, st in rows:
        a, b = i // 10, j // 10
        if i % 10 < 8 and j % 10 < 8 and a != b:
            held[st, min(a, b), max(a, b)].append((i, j, k) if a < b else (j, i, k))
    want = {}
    for key, v in held.items():
        par = sum(k == "P" for _, _, k in v) * 2 > len(v)
        if len(v) >= 2:
            want[key] = (len(v), "P" if par else "A", sorted(j - i if par else i + j for i, j, _ in v)[(len(v) + 1) // 2 - 1])
    br = spark.createDataFrame(rows, "entry string, i long, j long, kind string, st string")
    st = spark.createDataFrame(strands, "entry string, strand long, first long, last long")
    both = K.strand_pairings(br, st, ["entry"], by="st")
    assert {(r.st, r.a, r.b): (r.bridges, r.kind, r.register) for r in both.collect()} == want and len(want) > 10
    one = K.strand_pairings(br.filter("st = 'F'").drop("st"), st, ["entry"])
    assert {("F", r.a, r.b): (r.bridges, r.kind, r.register) for r in one.collect()} == {k: v for k, v in want.items() if k[0] == "F"}
    assert "percentile" not in both._jdf.queryExecution().optimizedPlan().toString()
