"""Interfaces count every kind of interaction and every contact, without a row for any near pair."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from molframe import bindings as B
from molframe.operators import contacts as C
from molframe.operators import interactions as I
from molframe.plans import tiles as T

ROOT = "/root/testdata/sf0.01"
FINDERS = {"hbond": I.hbonds_heavy, "salt": I.salt_bridges, "stack": I.pi_stacking, "cation-pi": I.cation_pi, "hydrophobic": I.hydrophobic_contacts}


def apart(p, q):
    return math.floor(math.sqrt(sum((a - b) ** 2 for a, b in zip(p[4:], q[4:]))) * 1000 + 0.5) / 1000


def test_every_kind_is_counted_as_its_finder_lists_it(spark):
    """Three of five kinds were left out: 0 for every two chains, in the code and in the SQL it was held against."""
    atoms = B.atoms(spark, ROOT)
    got = {(r.kind, r.chain_a, r.chain_b): r.n for r in I.chain_interactions(atoms).collect()}
    want = {}
    for kind, find in FINDERS.items():
        rows = find(atoms, "interchain").groupBy(F.least("a_chain", "b_chain").alias("a"), F.greatest("a_chain", "b_chain").alias("b")).count().collect()
        assert rows, kind
        want |= {(kind, r.a, r.b): r["count"] for r in rows}
    assert got == want


@pytest.mark.parametrize("piece", [8192, 3])
def test_faces_equal_a_plain_count(spark, monkeypatch, piece):
    monkeypatch.setattr(T, "PIECE", piece)
    monkeypatch.setattr(T, "MARKED", 64)
    monkeypatch.setattr(T, "BLOCK", 7)
    rng = random.Random(5)
    rows = [("e", f"c{rng.randrange(5)}", k, None if k % 9 == 0 else k // 6, *[round(rng.gauss(0, 7), 3) for _ in range(3)]) for k in range(300)]
    want = {}
    for p, q in itertools.combinations(rows, 2):
        if p[1] != q[1] and apart(p, q) <= 3.0:
            p, q = sorted((p, q), key=lambda v: v[1])
            n, one, two, both = want.setdefault((p[1], q[1]), [0, set(), set(), set()])
            want[p[1], q[1]][0] += 1
            one.add(p[2])
            two.add(q[2])
            if p[3] is not None and q[3] is not None:
                both.add((p[3], q[3]))
    faces = C.chain_faces(spark.createDataFrame(rows, "entry string, chain string, idx int, element int, x double, y double, z double"), 3.0)
    got = {(r.chain_a, r.chain_b): (r.contacts, r.residues_a, r.residues_b, r.element_pairs) for r in faces.collect()}
    assert got == {k: (n, len(a), len(b), len(e)) for k, (n, a, b, e) in want.items()} and any(n > len(e) for n, _, _, e in want.values())


def test_chains_with_an_interaction_alone_are_an_interface(spark):
    faces = spark.createDataFrame([("e", "A", "B", 3, 2, 2, 1)], "entry string, chain_a string, chain_b string, contacts bigint, residues_a bigint, residues_b bigint, element_pairs bigint")
    held = spark.createDataFrame([("e", "B", "A", "cation-pi", 2), ("e", "C", "A", "salt", 4)], "entry string, chain_a string, chain_b string, kind string, n bigint")
    got = sorted(tuple(r) for r in C.interfaces(faces, held).collect())
    assert got == [("e", "A", "B", "ca", 3, 2, 2, 1, 0, 0, 0, 2, 0), ("e", "A", "C", "ca", 0, 0, 0, 0, 0, 4, 0, 0, 0)]
