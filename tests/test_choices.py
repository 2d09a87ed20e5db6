"""Strands by contact and pairing, cropped stretches, pair types: small cases with known answers."""

import numpy as np
from test_symmetry import rot

from molframe.operators import pair_types as P
from molframe.operators import selection as S


def test_strands_touching_a_chain_and_their_partners(spark):
    contacts = spark.createDataFrame([("e", "A", 1), ("e", "B", 5), ("e", "A", 9), ("f", "A", 1), ("g", "B", 1)], "entry string, chain string, strand int")
    pairs = spark.createDataFrame([("e", 1, 2), ("e", 3, 2), ("e", 3, 3), ("e", 5, 6), ("f", 7, 8), ("g", 1, 2)], "entry string, strand_a int, strand_b int")
    chosen = spark.createDataFrame([("e", "A"), ("f", "A"), ("h", "A"), ("e", "A")], "entry string, chain string")
    got = sorted((r.entry, r.strand) for r in S.strands_touching(contacts, pairs, chosen).collect())
    assert got == [("e", 1), ("e", 2), ("e", 3), ("e", 9), ("f", 1)]
    assert S.contacts_of(contacts, chosen).count() == 3
    assert S.strands_touching(contacts, pairs, chosen.filter("entry = 'h'")).count() == 0
    assert S.strands_touching(contacts, pairs.limit(0), chosen).count() == 3


def test_windows_follow_base_pairs(spark):
    strands = spark.createDataFrame([("e", 1, 0, 40), ("e", 2, 0, 40), ("e", 3, 0, 9), ("e", 4, 0, 9)], "entry string, strand int, lo int, hi int")
    touched = spark.createDataFrame([("e", 1, 10), ("e", 1, 14), ("e", 1, 12)], "entry string, strand int, pos int")
    # strand 2 pairs with 1; strand 3 with the part of 2 that comes in by that
    pairs = spark.createDataFrame([("e", 1, i, 2, 35 - i) for i in range(0, 30)] + [("e", 2, 20, 3, 4), ("e", 2, 39, 4, 4)], "entry string, strand_a int, pos_a int, strand_b int, pos_b int")
    w = S.touched_windows(touched, strands, pairs, flank=3)
    got = {r.strand: (r.first, r.last, r.before, r.after) for r in S.crop_gaps(w, strands).collect()}
    assert got == {1: (7, 17, 7, 23), 2: (18, 28, 18, 12), 3: (4, 4, 4, 5)}
    # the ends of a strand bound it
    w = S.touched_windows(touched, strands, pairs.limit(0), flank=30).collect()
    assert [(r.strand, r.first, r.last) for r in w] == [(1, 0, 40)]


def test_pair_types_of_authored_entries(spark):
    rng = np.random.default_rng(1)
    base = rng.uniform(-15, 15, (60, 3))
    bent = base.copy()
    bent[30:] = bent[30:] @ rot((0, 0, 1), 60).T
    forms = {"apo": base, "holo": base @ rot((1, 1, 0), 40).T + 3, "open": bent, "dimer": base + 5, "short": base[:20]}
    rows = [(e, i, "", *map(float, np.round(p, 3))) for e, xyz in forms.items() for i, p in enumerate(xyz)]
    traces = spark.createDataFrame(rows, "entry string, seq int, icode string, x double, y double, z double")
    f = spark.createDataFrame([("apo", "P1", False, 1), ("holo", "P1", True, 1), ("open", "P1", False, 1), ("dimer", "P1", False, 2), ("short", "P1", False, 1), ("else", "P2", False, 1)], "entry string, accession string, ligand_touching boolean, assembly_chains int")
    t = P.pair_types(f, traces)
    got = {(r.entry_a, r.entry_b): (r.types, r.rmsd) for r in t.collect()}
    assert len(got) == 10
    assert got["apo", "holo"] == (["apo/holo"], None)
    assert got["apo", "dimer"] == (["monomer/oligomer"], 0.0)
    assert got["apo", "open"][0] == ["open/closed"] and got["apo", "open"][1] > 3
    assert got["dimer", "open"][0] == ["monomer/oligomer", "open/closed"]
    assert got["dimer", "holo"] == (["apo/holo", "monomer/oligomer"], None)
    assert got["apo", "short"] == ([], None)  # too few residues in common
    few = spark.createDataFrame([("P1", "apo", "open")], "accession string, entry_a string, entry_b string")
    assert [r.types for r in P.pair_types(f, traces, few).collect()] == [["open/closed"]]
    assert {r.type: r.pairs for r in P.type_counts(t).collect()} == {"apo/holo": 4, "monomer/oligomer": 4, "open/closed": 2}
