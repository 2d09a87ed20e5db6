"""Sheets: strand pairings, order along a sheet, directions, barrels, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.plans.graph import bfs, both_ways, components, cyclic_flag, max_spanning_forest, tree_track
from molframe.plans.intervals import points_in
from molframe.session import cut


def bridge_pairs(bridges: DataFrame, strands: DataFrame, keys: list[str]) -> DataFrame:
    """Bridges (i, j, kind) with the strands a < b that hold their ends. strands: keys, strand, first, last."""
    own = strands.select(*keys, "strand", "first", "last")
    p = points_in(bridges.select(*keys, "i", "j", "kind"), own, keys, "i", "first", "last").withColumnRenamed("strand", "sa").drop("first", "last")
    p = points_in(p, own, keys, "j", "first", "last").withColumnRenamed("strand", "sb").drop("first", "last").filter("sa <> sb")
    turn = F.col("sa") > F.col("sb")
    return p.select(*keys, F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"), F.when(turn, F.col("j")).otherwise(F.col("i")).alias("i"),
                    F.when(turn, F.col("i")).otherwise(F.col("j")).alias("j"), "kind")


def edge_table(pairs: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Bridges per strand pair (keys, a, b), kind by majority, kept from two."""
    e = pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("bridges"), F.count_if(F.col("kind") == "P").alias("_p"))
    kind = F.when(F.col("_p") * 2 > F.col("bridges"), F.lit("P")).otherwise(F.lit("A"))
    return e.filter(F.col("bridges") >= least).select(*keys, "a", "b", "bridges", kind.alias("kind"))


def build_sheets(edges: DataFrame, weak: DataFrame, keys: list[str]) -> DataFrame:
    """Strands of every sheet: keys, sheet (its least strand), strand, position (null off the track), parent,
    direction (+1 or -1 along the first strand), closed.

    A sheet is a component of the edge table; its order is the longest path of its heaviest spanning tree. It is
    closed when its pairings have a cycle and its two ends are bridged, or when five or more strands end to end are
    joined by a lone bridge (`weak`: the edge table from one bridge up)."""
    e = cut(edges)
    tree = cut(max_spanning_forest(e, keys, "a", "b", "bridges"))
    track, off = tree_track(tree, keys, "a", "b")
    track = cut(track)
    start = track.groupBy(*keys, "component").agg(F.min("place").alias("_p0"))
    first = track.join(start, [*keys, "component"]).filter("place = _p0").select(*keys, "node")
    kinds = tree.join(e.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind"), [*keys, "a", "b"])
    walk = bfs(kinds, keys, "a", "b", first, F.when(F.col("kind") == "A", F.lit(-1)).otherwise(F.lit(1)))
    cyc = cyclic_flag(e, keys, "a", "b").select(*keys, "component", F.col("closed").alias("cyclic"))
    ends = track.groupBy(*keys, "component").agg(
        F.min_by("node", "place").alias("x"), F.max_by("node", "place").alias("y"), F.count(F.lit(1)).alias("n")
    )
    lone = weak.select(*keys, F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct().withColumn("w", F.lit(True))
    ends = ends.select(*keys, "component", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "n").join(lone, [*keys, "x", "y"], "left")
    branched = off.select(*keys, "component").distinct().withColumn("branched", F.lit(True))
    c = ends.join(cyc, [*keys, "component"]).join(branched, [*keys, "component"], "left")
    meets, plain = F.coalesce("w", F.lit(False)), F.col("branched").isNull()
    closed = meets & plain & (F.col("cyclic") | (F.col("n") >= 5))
    c = c.select(*keys, "component", closed.alias("closed"))
    every = track.select(*keys, "component", "node", F.col("place").cast("int").alias("position"), F.lit(None).cast(off.schema["parent"].dataType).alias("parent"))
    every = every.unionByName(off.select(*keys, "component", "node", F.lit(None).cast("int").alias("position"), "parent"))
    out = every.join(c, [*keys, "component"]).join(walk.select(*keys, "node", F.col("sign").alias("direction")), [*keys, "node"])
    return out.select(*keys, F.col("component").alias("sheet"), F.col("node").alias("strand"), "position", "parent", "direction", "closed")


def pair_registers(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Register of every strand pair: low median of j - i (parallel) or i + j (antiparallel)."""
    g = pairs.groupBy(*keys, "a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "P").alias("_p"),
        F.expr("percentile_disc(0.5) within group (order by j - i)").alias("_rp"), F.expr("percentile_disc(0.5) within group (order by i + j)").alias("_ra"),
    )
    par = F.col("_p") * 2 > F.col("n")
    return g.select(*keys, "a", "b", F.when(par, F.lit("P")).otherwise(F.lit("A")).alias("kind"), F.when(par, F.col("_rp")).otherwise(F.col("_ra")).cast("bigint").alias("register"))


def barrel_numbers(sheets: DataFrame, registers: DataFrame, keys: list[str]) -> DataFrame:
    """n and the shear number of each closed sheet whose pairings run once round: the registers composed along the
    ring, as maps x -> sign * x + shift. A ring is a few dozen strands, one array each."""
    ring = sheets.filter("closed and position is not null")
    w = Window.partitionBy(*keys, "sheet").orderBy("position")
    nxt = F.lead("strand").over(w)
    first = F.first("strand").over(w)
    ring = ring.withColumn("next", F.coalesce(nxt, first))
    r = registers.select(*keys, F.col("a").alias("strand"), F.col("b").alias("next"), "kind", "register", F.lit(True).alias("fwd")).unionByName(
        registers.select(*keys, F.col("b").alias("strand"), F.col("a").alias("next"), "kind", "register", F.lit(False).alias("fwd"))
    )
    j = ring.join(r, [*keys, "strand", "next"])
    par = F.col("kind") == "P"
    sign = F.when(par, F.lit(1)).otherwise(F.lit(-1)).cast("bigint")
    shift = F.when(par & ~F.col("fwd"), -F.col("register")).otherwise(F.col("register"))
    g = j.groupBy(*keys, "sheet").agg(F.array_sort(F.collect_list(F.struct("position", sign.alias("s"), shift.alias("d")))).alias("steps"))
    whole = F.aggregate(
        "steps", F.struct(F.lit(1).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("d")),
        lambda acc, x: F.struct((acc["s"] * x["s"]).alias("s"), (x["s"] * acc["d"] + x["d"]).alias("d")),
    )
    g = g.withColumn("m", whole)
    return g.select(*keys, "sheet", F.size("steps").alias("barrel_n"), F.when(F.col("m.s") == 1, F.abs("m.d")).alias("shear"))


def sheet_checks(sheets: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbours in a sheet's order (and accessory strands with their parent) that no edge joins."""
    w = Window.partitionBy(*keys, "sheet").orderBy("position")
    near = sheets.filter("position is not null").withColumn("other", F.lead("strand").over(w)).filter("other is not null")
    near = near.select(*keys, "sheet", F.col("strand").alias("a"), F.col("other").alias("b"), F.lit("neighbour").alias("what"))
    hang = sheets.filter("parent is not null").select(*keys, "sheet", F.col("strand").alias("a"), F.col("parent").alias("b"), F.lit("accessory").alias("what"))
    every = near.unionByName(hang)
    e = both_ways(edges, keys, "a", "b").select(*keys, F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    return every.join(e, [*keys, "a", "b"], "left_anti")


def alpha_beta_rows(sheets: DataFrame, strands: DataFrame, helices: DataFrame, kinds: DataFrame, keys: list[str]) -> DataFrame:
    """All-parallel open sheets of four or more strands where at least three fifths of a chain's consecutive strands
    are neighbours in the sheet with a helix between them along the chain.

    strands: keys, strand, chain, first, last; helices: keys, chain, first, last; kinds: keys, a, b, kind."""
    s = sheets.join(strands, [*keys, "strand"])
    par = kinds.join(sheets.select(*keys, F.col("strand").alias("a"), "sheet"), [*keys, "a"]).groupBy(*keys, "sheet").agg(F.bool_and(F.col("kind") == "P").alias("parallel"))
    size = sheets.groupBy(*keys, "sheet").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("position").isNotNull()).alias("plain"), F.bool_or("closed").alias("closed"))
    ok = size.join(par, [*keys, "sheet"]).filter("parallel and plain and not closed and n >= 4").select(*keys, "sheet")
    s = s.join(ok, [*keys, "sheet"], "left_semi")
    w = Window.partitionBy(*keys, "sheet", "chain").orderBy("first")
    u = s.withColumn("n_first", F.lead("first").over(w)).withColumn("n_pos", F.lead("position").over(w)).filter("n_first is not null")
    u = u.withColumn("near", F.abs(F.col("n_pos") - F.col("position")) == 1).withColumn("lo", F.col("last") + 1).withColumn("hi", F.col("n_first") - 1)
    h = helices.select(*keys, "chain", F.col("first").alias("hs"), F.col("last").alias("he"))
    hit = points_in(h, u.filter("lo <= hi").select(*keys, "chain", "sheet", "strand", "lo", "hi"), [*keys, "chain"], "hs", "lo", "hi").filter("he <= hi")
    hit = hit.select(*keys, "sheet", "strand").distinct().withColumn("helix", F.lit(True))
    u = u.join(hit, [*keys, "sheet", "strand"], "left")
    unit = F.col("near") & F.coalesce("helix", F.lit(False))
    g = u.groupBy(*keys, "sheet").agg(F.count(F.lit(1)).alias("steps"), F.count_if(unit).alias("units"))
    return g.withColumn("row", F.col("units") * 5 >= F.col("steps") * 3)


def helix_partners_subset(elements: DataFrame, chains: list[str], bridges: DataFrame, packing: DataFrame, keys: list[str]) -> DataFrame:
    """A subunit's elements and those of other chains that complete its fold: strands bridged to its strands, helices
    packed on its helices. bridges and packing: keys, a, b (element ids)."""
    own = elements.filter(F.col("chain").isin(chains)).select(*keys, "element")
    link = both_ways(bridges, keys, "a", "b").union(both_ways(packing, keys, "a", "b")).distinct()
    near = link.join(own.withColumnRenamed("element", "src"), [*keys, "src"], "left_semi").select(*keys, F.col("dst").alias("element"))
    return elements.join(own.union(near).distinct(), [*keys, "element"], "left_semi")
