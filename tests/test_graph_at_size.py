"""Components at size: node tables are not gathered in the driver, edges shrink from round to round, names are the least nodes."""

import random

from molframe.plans import graph as G


def test_components_are_named_by_their_least_node_without_broadcasts(spark, monkeypatch):
    rng = random.Random(11)
    edges, want = [], {}
    for g in ("x", "y"):
        for part in range(4):
            names = [f"n{part}_{v:03d}" for v in rng.sample(range(1000), 40)]
            line = [(names[i], names[i + 1]) for i in range(39)]  # a long line meets no neighbour of neighbours early
            edges += [(g, *(e if rng.random() < 0.5 else e[::-1])) for e in line + line[:3]]
            want |= {(g, n): min(names) for n in names}
        edges.append((g, "alone", "alone"))
        want[g, "alone"] = "alone"
    plans, sizes, plain = [], [], G.cut

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = plain(df)
        if "_a" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(G, "cut", watched)
    got = G.components(spark.createDataFrame(edges, "g string, a string, b string"), ["g"], "a", "b").collect()
    assert {(r.g, r.node): r.component for r in got} == want and len(got) == len(want)
    assert not any("BroadcastHashJoin" in p for p in plans)
    assert sizes[-1] == 0 and all(2 * b <= a for a, b in zip(sizes, sizes[1:]))
