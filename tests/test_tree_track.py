"""The longest paths of trees, whichever way they are found, are those of three plain walks."""

import random

import pytest

from molframe.plans import graph as G


def forest(seed):
    rng = random.Random(seed)
    out = []
    for t, size in enumerate([2, 3, 4, 5, 5, 6, 7, 8, 9, 12, 20, 40, 90]):
        names = [f"{n:03d}" for n in rng.sample(range(100 * t, 100 * t + 99), size)]
        for k in range(1, size):
            # bushy and long ones in turn
            out.append(("ef"[t % 2], names[k], names[rng.randrange(max(0, k - 3), k) if t % 3 else rng.randrange(k)]))
    hub = [f"9{n:03d}" for n in range(60)]
    return out + [("e", hub[30], h) for h in hub if h != hub[30]] + [("f", hub[0], h) for h in hub[1:50]] + [("f", hub[7], f"8{n:03d}") for n in range(9)]


def plain(edges):
    near = {}
    for g, a, b in edges:
        near.setdefault((g, a), set()).add((g, b))
        near.setdefault((g, b), set()).add((g, a))

    def walk(root):
        depth, parent, line = {root: 0}, {root: None}, [root]
        for v in line:
            for w in sorted(near[v]):
                if w not in depth:
                    depth[w], parent[w] = depth[v] + 1, v
                    line.append(w)
        return depth, parent

    on, off, seen = set(), set(), set()
    for root in sorted(near):
        if root in seen:
            continue
        far = lambda d: min(d, key=lambda v: (-d[v], v))
        one, _ = walk(root)
        seen |= set(one)
        depth, parent = walk(far(one))
        v, path = far(depth), set()
        while v is not None:
            path.add(v)
            v = parent[v]
        on |= {(v[0], root[1], v[1], depth[v]) for v in path}
        off |= {(v[0], root[1], v[1], parent[v][1]) for v in one if v not in path}
    return on, off


def test_trees_in_one_call_equal_plain_walks():
    import pyarrow as pa

    for seed in range(40):
        edges = forest(seed)
        on, off = plain(edges)
        name = {(g, v): c for g, c, v, _ in on | off}
        t = pa.table({"entry": [g for g, *_ in edges], "a": [a for _, a, _ in edges], "b": [b for *_, b in edges], "component": [name[g, a] for g, a, _ in edges]})
        got = G._peeled(["entry"])(t).to_pylist()
        assert {(r["entry"], r["component"], r["node"], r["place"]) for r in got if r["place"] is not None} == on
        assert {(r["entry"], r["component"], r["node"], r["parent"]) for r in got if r["place"] is None} == off and len(got) == len(on) + len(off)


@pytest.mark.parametrize("whole", [1_000_000, 45])
def test_track_equals_plain_walks(spark, monkeypatch, whole):
    monkeypatch.setattr(G, "WHOLE", whole)
    edges = forest(whole)
    on, off = G.tree_track(spark.createDataFrame(edges, "entry string, a string, b string"), ["entry"], "a", "b")
    got = [tuple(r) for r in on.select("entry", "component", "node", "place").collect()], [tuple(r) for r in off.select("entry", "component", "node", "parent").collect()]
    want = plain(edges)
    assert (len(got[0]), len(got[1])) == (len(want[0]), len(want[1]))
    assert (set(got[0]), set(got[1])) == want


def test_trees_are_not_walked_layer_by_layer(spark, monkeypatch):
    """Every layer of three walks was a join over all trees, so the time went with the longest of them."""
    monkeypatch.setattr(G, "bfs", None)
    n = 400
    on, off = G.tree_track(spark.createDataFrame([("e", k, k + 1) for k in range(n)], "entry string, a int, b int"), ["entry"], "a", "b")
    assert sorted((r.node, r.place) for r in on.collect()) == [(k, n - k) for k in range(n + 1)] and off.count() == 0
