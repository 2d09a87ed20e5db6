"""Levels of clashing items: only items with a better rival take part in the rounds."""

from molframe.plans import rounds as R


def test_items_without_rivals_take_part_in_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(R, "cut", lambda d, f=R.cut: written.append(f(d)) or written[-1])
    items = spark.range(1000).selectExpr("'g' as g", "id as item")
    clash = spark.createDataFrame([("g", 5, "g", 3), ("g", 7, "g", 5), ("g", 7, "g", 3), ("g", 8, "g", 7)], "g string, item long, g_by string, item_by long")
    got = {r["item"]: r.level for r in R.lowest_free_level(items, clash, ["g", "item"]).collect()}
    assert got == {k: 0 for k in range(1000)} | {5: 1, 7: 2}
    assert max(d.count() for d in written) <= 4  # every item: 1,000
