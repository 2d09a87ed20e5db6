"""Units in touch, held against a plain count, on inputs whose near pairs of points must not become rows."""

import random

import numpy as np
import pytest

from molframe.operators import contacts as C
from molframe.operators import interactions as I
from molframe.operators import nucleic as N
from molframe.plans import tiles as T


def cloud(seed, n, units, wide):
    rng = random.Random(seed)
    return [("e", rng.randrange(units), k, *[round(rng.gauss(0, wide), 3) for _ in range(3)], rng.randrange(2)) for k in range(n)]


def touching(a, b, reach, same):
    out = {}
    for p in a:
        for q in b:
            d = np.floor(np.sqrt((p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2 + (p[5] - q[5]) ** 2) * 1000 + 0.5) / 1000
            if d <= reach[p[6]][q[6]] and not (same and p[1] >= q[1]):
                n, least = out.get((p[1], q[1]), (0, 1e9))
                out[p[1], q[1]] = (n + 1, min(least, d))
    return out


@pytest.mark.parametrize("piece", [8192, 9])
def test_units_touching_equals_a_plain_count(spark, monkeypatch, piece):
    monkeypatch.setattr(T, "PIECE", piece)
    monkeypatch.setattr(T, "TILE", 64)
    monkeypatch.setattr(T, "BLOCK", 7)
    a, b = cloud(1, 230, 19, 6.0), cloud(2, 170, 13, 6.0)
    cols = "entry string, u int, idx int, x double, y double, z double, kind_ int"
    da, db = spark.createDataFrame(a, cols), spark.createDataFrame(b, cols)
    reach = [[3.0, 1.5], [-1.0, 2.0]]
    got = [((r.u_a, r.u_b), (r.pairs, r.distance)) for r in T.units_touching(da, db, ["u"], ["u"], reach).collect()]
    assert len(got) == len(dict(got)) > 20 and dict(got) == touching(a, b, reach, False)
    got = [((min(r.u_a, r.u_b), max(r.u_a, r.u_b)), (r.pairs, r.distance)) for r in T.units_touching(da, None, ["u"], ["u"], [[2.5, 2.5], [2.5, 2.5]]).collect()]
    assert len(got) == len(dict(got)) > 20 and dict(got) == touching(a, a, [[2.5, 2.5], [2.5, 2.5]], True)


def test_no_pair_of_atoms_is_a_row(spark):
    """Two tables of crowded residues: the former join counted every near pair of atoms and sent the counts on."""
    rng = random.Random(4)
    atom = lambda k, name, res: ("e", "A", k // 8, "", res, name, "C", k, *[round(rng.gauss(0, 3), 3) for _ in range(3)])
    rows = [atom(k, f"C{k % 8}", ("ALA", "G", "LIG")[k // 8 % 3]) for k in range(240)]
    atoms = spark.createDataFrame(rows, "entry string, chain string, seq int, icode string, resname string, atom string, elem string, idx int, x double, y double, z double")
    points = atoms.selectExpr("entry", "idx", "seq as element", "x", "y", "z")
    for d in (N.na_contacts(atoms), I.ligand_contacts(atoms), C.element_contacts(points)):
        assert d.count() > 50
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan[: plan.index("FlatMapCoGroups")] and "Aggregate" not in plan[: plan.index("FlatMapCoGroups")]
