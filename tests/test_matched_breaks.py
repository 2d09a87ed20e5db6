"""Helices broken in some copies of a protein and whole in others."""

from molframe.operators import backbone as K


def test_most_copies_decide(spark):
    helices = {
        # one whole, two broken: cut
        "A": [(1, 20)], "B": [(1, 9), (11, 20)], "C": [(1, 9), (11, 20)],
        # one broken twice, three whole: joined
        "D": [(1, 9), (11, 20), (23, 40)], "E": [(1, 40)], "F": [(1, 40)], "G": [(1, 40)],
        # a tie: cut, but not where a piece would be short
        "H": [(1, 20), (50, 69)], "I": [(1, 4), (6, 20), (50, 59), (61, 69)],
        # broken in all copies, and by three residues
        "J": [(1, 9), (11, 20), (50, 59), (63, 70)], "K": [(1, 9), (11, 20), (50, 70)],
        # in no group
        "L": [(1, 9), (11, 20)],
    }
    groups = dict(zip("ABCDEFGHIJK", "11122223344"))
    rows = [("e", c, a, b) for c, runs in helices.items() for a, b in runs]
    table = spark.createDataFrame(rows, "entry string, chain string, first long, last long")
    copies = spark.createDataFrame([("e", c, g) for c, g in groups.items()], "entry string, chain string, copy_group string")
    want = {c: [(a, b, None) for a, b in runs] for c, runs in helices.items()}
    want["A"] = [(1, 9, "cut"), (11, 20, "cut")]
    want["D"] = [(1, 40, "joined")]
    want["H"] = [(1, 20, None), (50, 59, "cut"), (61, 69, "cut")]
    for parts in (1, 7):
        got = {}
        for r in K.match_breaks(table.repartition(parts), copies).collect():
            got.setdefault(r.chain, []).append((r.first, r.last, r.change))
        assert {c: sorted(v, key=lambda x: x[0]) for c, v in got.items()} == want
    assert K.match_breaks(table.limit(0), copies).count() == 0
