"""Positions are numbered from the modelled ones alone; stretches are spread out last."""

import random

from molframe.operators import chains as H


def test_track_positions_equals_a_plain_search(spark):
    rng = random.Random(9)
    spans = [("a", 1, 90, "X"), ("a", 95, 130, "Y"), ("b", -20, 40, "X"), ("c", 5, 9, "X"), ("d", 7, 7, "Z")]
    model = [("a", p, 500 + 2 * p) for p in rng.sample(range(1, 140), 9)] + [("a", 92, 7), ("b", -20, 1), ("b", 3, 50), ("b", 4, -6), ("d", 8, 1)]
    rows = [(c, p, n) for c, lo, hi, n in spans for p in range(lo, hi + 1)]
    want = set()
    for c, p, n in rows:
        known = sorted((abs(q - p), q, k) for e, q, k in model if e == c and any(d == c and lo <= q <= hi for d, lo, hi, _ in spans))
        want.add((c, p, n, bool(known) and known[0][0] == 0, p + known[0][2] - known[0][1] if known else None))
    m = spark.createDataFrame(model, "entry string, pos long, number long")
    for s in (spark.createDataFrame(spans, "entry string, first long, last long, name string"), spark.createDataFrame(rows, "entry string, pos long, name string")):
        for block in (4096, 16):
            d = H.track_positions(s, m, ["entry"], block)
            got = [tuple(r) for r in d.select("entry", "pos", "name", "observed", "number").collect()]
            assert len(got) == len(rows) and set(got) == want
    # of stretches, no position is sent or put in order
    plan = H.track_positions(spark.createDataFrame(spans, "entry string, first long, last long, name string"), m, ["entry"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sequence(first") < plan.index("Join")
