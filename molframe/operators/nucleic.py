"""Nucleic acids: strands, base pairs, stems, loops, pseudoknots, text forms."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.functions import chemistry as chem
from molframe.functions.geom import Vec, dist, snap, vec
from molframe.functions.linalg import eig3
from molframe.operators.interactions import RES, polymer_atoms
from molframe.plans.graph import components
from molframe.plans.intervals import points_in, spans_meeting
from molframe.plans.ordered import Ordered, block_of
from molframe.plans.rounds import keep_unless_beaten, lowest_free_level, mutual_best
from molframe.plans.spatial import pairs_between, worked_out
from molframe.plans.tiles import units_touching
from molframe.session import cut

RING = ["N1", "C2", "N3", "C4", "C5", "C6"]


def na_contacts(atoms: DataFrame, most: float = 4.0) -> DataFrame:
    """Nucleotide and amino-acid pairs with heavy atoms within 4.0: nearest distance and the number of atom pairs."""
    p = polymer_atoms(atoms)
    p = p.select(*RES, "kind", "idx", "x", "y", "z").withColumn("kind_", F.lit(0))
    near = units_touching(p.filter("kind = 'nucleic'"), p.filter("kind = 'protein'"), RES[1:], RES[1:], [[most]])
    return near.withColumnRenamed("pairs", "atom_pairs")


def parent_base(names: Column) -> Column:
    """Base of a nucleotide, modified or not, by its ring and exocyclic atoms."""
    has = lambda a: F.array_contains(names, a)
    purine = has("N9") | has("N7")
    return (
        F.when(purine & has("O6") & ~has("N2"), "I").when(purine & has("O6"), "G").when(purine & has("N6"), "A").when(purine, None)
        .when(has("N4"), "C").when(has("O4") & has("N3") & (has("C7") | has("C5M")), "T").when(has("O4") & has("N3"), "U")
    )


def _by_name(found: Column) -> Column:
    """(name, place) entries from (name, idx, place), the first in the file where a name is repeated."""
    rows = F.array_sort(found)
    first = F.filter(rows, lambda r, i: (i == 0) | (F.get(rows, i - 1)["atom"] != r["atom"]))
    return F.transform(first, lambda r: F.struct(r["atom"], r["at"]))


def nucleotides(atoms: DataFrame) -> DataFrame:
    """One row per nucleotide: atoms by name, C1', glycosidic vector, base normal and its place in the strand."""
    n = polymer_atoms(atoms).filter("kind = 'nucleic'")
    at = F.struct("x", "y", "z")
    ring = F.col("atom").isin(RING)
    u = {c: F.when(ring, F.col(c)) for c in "xyz"}
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    g = n.groupBy(*RES, "resname").agg(
        F.map_from_entries(_by_name(F.collect_list(F.struct("atom", "idx", at.alias("at"))))).alias("at"), F.collect_set("atom").alias("names"),
        F.min("idx").alias("idx"), F.count_if(ring).alias("k"), *[F.avg(u[c]).alias("m" + c) for c in "xyz"],
        *[F.sum(u[p[0]] * u[p[1]]).alias("s" + p) for p in pairs],
    )
    cov = F.array(*[F.coalesce(F.col("s" + p) - F.col("k") * F.col("m" + p[0]) * F.col("m" + p[1]), F.lit(0.0)) for p in pairs])
    g = g.withColumn("base", parent_base(F.col("names"))).withColumn("_e", eig3(cov))
    c1 = F.try_element_at("at", F.lit("C1'"))
    near = lambda a: F.when(dist(vec(F.try_element_at("at", F.lit(a))), vec(c1)) < 1.7, F.try_element_at("at", F.lit(a)))
    root = F.coalesce(near("N9"), near("N1"), near("C5"))
    turned = near("N9").isNull() & near("N1").isNull() & near("C5").isNotNull()
    v = F.col("_e.vectors")
    normal = F.when(F.col("k") >= 4, F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z")))
    gly = vec(root).minus(vec(c1))
    g = g.select(*RES, "resname", "base", "at", "idx", c1.alias("c1"), turned.alias("turned"), normal.alias("normal"),
                 F.when(root.isNotNull(), gly.struct()).alias("gly"))
    return g


def na_strands(nts: DataFrame, most: float = 2.0) -> DataFrame:
    """Nucleotides with strand and place: a chain is cut where O3' and the next P are more than 2.0 apart."""
    o3, p = F.try_element_at("at", F.lit("O3'")), F.try_element_at("at", F.lit("P"))
    d = nts.withColumn("_o3", o3).withColumn("_p", p)
    o = Ordered(d, ["entry", "chain"], ["idx"], block_of(F.col("idx"))).neighbour(["_o3", "idx"], "prev_")
    linked = dist(vec("prev__o3"), vec("_p")) <= most
    cut_here = F.col("prev_idx").isNull() | ~F.coalesce(linked, F.lit(False))
    o = o.islands(cut_here, "strand").row_number("pos")
    return o.done().drop("_o3", "_p", "prev__o3", "prev_idx")


def base_pair_candidates(nts: DataFrame, strict: float = 3.8, stretched: float = 4.0) -> DataFrame:
    """Watson-Crick and wobble candidates, each once, lower place as _a: bonds held, their mean, kind, tight.

    `nts` needs entry, strand, pos (place over the whole chain), idx and what `nucleotides` gives."""
    has = lambda n: F.try_element_at("at", F.lit(n))
    pur, pyr = ({r[k] for r in chem.BASE_PAIRS} for k in (0, 1))
    give, take = (sorted({b[k] for r in chem.BASE_PAIRS for b in r[2]}) for k in (0, 1))
    # the atoms that bonds are measured between; a turned pyrimidine shows its O2 in the place of O4
    turn = {"O4": "O2", "O2": "O4"}
    shown = lambda n: F.when(F.col("turned"), has(turn[n])).otherwise(has(n)) if n in turn else has(n)
    c = cut(nts.filter(F.col("base").isin(*pur, *pyr) & F.col("c1").isNotNull()).select(
        "entry", "chain", "strand", "pos", "idx", "base", "normal", "gly", F.col("c1.x").alias("x"), F.col("c1.y").alias("y"), F.col("c1.z").alias("z"),
        F.struct(*[has(n).alias(n) for n in give]).alias("give"), F.struct(*[shown(n).alias(n) for n in take]).alias("take"),
    ))
    apart = (F.col("chain_a") != F.col("chain_b")) | (F.col("strand_a") != F.col("strand_b")) | (F.abs(F.col("pos_a") - F.col("pos_b")) > 3)
    rule = lambda r: (F.col("base_a") == r[0]) & (F.col("base_b") == r[1])
    any_rule = reduce(or_, [rule(r) for r in chem.BASE_PAIRS])
    of_rule = lambda value: F.coalesce(*[F.when(rule(r), value(r)) for r in chem.BASE_PAIRS])
    # a purine as _a and a pyrimidine as _b: no others pair
    near = pairs_between(c.filter(F.col("base").isin(*pur)).drop("take"), c.filter(F.col("base").isin(*pyr)).drop("give"), 12.0,
                         where=any_rule & apart & (F.col("distance") >= 9.0)).drop("distance")
    cos = F.abs(vec("normal_a").dot(vec("normal_b")))
    flat = F.coalesce(cos >= F.lit(0.7071067811865476), F.lit(True))
    u = Vec(F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a"), F.col("z_b") - F.col("z_a"))
    n, m = vec("gly_a").cross(u), u.cross(vec("gly_b"))
    cis = F.coalesce(n.dot(m) < F.lit(-0.5) * n.norm() * m.norm(), F.lit(True))
    # planes and sides first: they cost less than bonds and leave few
    near = worked_out(near, _faces=flat & cis).filter("_faces")
    length = lambda b: dist(vec(F.col("give_a")[b[0]]), vec(F.col("take_b")[b[1]]))
    j = worked_out(near, kind=of_rule(lambda r: F.lit(r[4])), need=of_rule(lambda r: F.lit(r[3])),
                   _l=F.array_sort(F.filter(of_rule(lambda r: F.array(*[length(b) for b in r[2]])), lambda d: d.isNotNull())))
    found = F.filter("_l", lambda d: d <= strict)
    tight = F.size(found) >= F.col("need")
    at = lambda k: F.try_element_at("_l", k.cast("int"))
    loose = (F.size("_l") >= F.col("need")) & (at(F.col("need") - 1) <= strict) & (at(F.col("need")) <= stretched)
    held = F.when(tight, found).otherwise(F.filter("_l", lambda d: d <= stretched))
    mean = F.aggregate(held, F.lit(0.0), lambda s, d: s + d) / F.size(held)
    j = j.withColumn("held", F.size(held)).withColumn("mean", mean).withColumn("tight", tight).filter(tight | F.coalesce(loose, F.lit(False)))
    side, back = ["chain", "strand", "pos", "idx"], F.col("idx_a") > F.col("idx_b")
    turned = lambda c, here, there: F.when(back, F.col(c + there)).otherwise(F.col(c + here)).alias(c + here)
    return j.select("entry", *[turned(c, "_a", "_b") for c in side], *[turned(c, "_b", "_a") for c in side], "kind", "held", "mean", "tight")


def pair_nucleotides(cand: DataFrame) -> DataFrame:
    """Mutual best strict pairs, then stretched ones that are the next step of a strict pair's helix."""
    both = lambda d: d.unionByName(d.select("entry", *[F.col(k + s).alias(k + t) for s, t in (("_b", "_a"), ("_a", "_b")) for k in ("chain", "strand", "pos", "idx")], "kind", "held", "mean", "tight"))

    def best(d: DataFrame) -> DataFrame:
        rank = F.struct((-F.col("held")).alias("h"), F.col("mean").alias("m"), F.least("idx_a", "idx_b").alias("x"), F.greatest("idx_a", "idx_b").alias("y"))
        two = both(d).withColumn("_r", rank)
        top = two.groupBy("entry", "idx_a").agg(F.min(F.struct("_r", "idx_b")).alias("b")).select("entry", "idx_a", F.col("b.idx_b").alias("idx_b"))
        back = top.select("entry", F.col("idx_a").alias("idx_b"), F.col("idx_b").alias("idx_a"))
        mutual = top.join(back, ["entry", "idx_a", "idx_b"]).filter("idx_a < idx_b")
        return d.join(mutual, ["entry", "idx_a", "idx_b"], "left_semi")

    strict = best(cand.filter("tight"))
    return strict.unionByName(best(stretched_pairs(strict, cand.filter("not tight"))))


def stretched_pairs(strict: DataFrame, cand: DataFrame) -> DataFrame:
    """Candidates among unpaired nucleotides that stack in register on a strict pair."""
    used = strict.select("entry", F.col("idx_a").alias("i")).union(strict.select("entry", F.col("idx_b").alias("i"))).distinct()
    free = cand.join(used.withColumnRenamed("i", "idx_a"), ["entry", "idx_a"], "left_anti")
    free = free.join(used.withColumnRenamed("i", "idx_b"), ["entry", "idx_b"], "left_anti")
    key = ["entry", "chain_a", "strand_a", "pos_a", "chain_b", "strand_b", "pos_b"]
    step = lambda k: strict.select("entry", "chain_a", "strand_a", (F.col("pos_a") + k).alias("pos_a"), "chain_b", "strand_b", (F.col("pos_b") - k).alias("pos_b"))
    return free.join(step(1).union(step(-1)).distinct(), key, "left_semi").select(*cand.columns)


def rings_of_four(edges: DataFrame, group: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Distinct directed four-rings of an edge table, each as a sorted array.

    A ring is entered at its node of most edges (by name among equals), so a walk of two steps goes through lesser nodes only and the
    walks stay few where some nodes have very many edges. Rings are never shuffled but those whose opposite nodes are joined: only these
    may come again from another entry."""
    e = edges.filter(F.col(a) != F.col(b)).select(*group, F.col(a).alias("p"), F.col(b).alias("q")).distinct()
    e = cut(e)
    ends = e.select(*group, F.col("p").alias("n")).unionByName(e.select(*group, F.col("q").alias("n")))
    place = ends.groupBy(*group, "n").agg(F.count(F.lit(1)).alias("k"))
    at = lambda x: place.select(*group, F.col("n").alias(x), F.struct((-F.col("k")).alias("k"), "n").alias("_" + x))
    e = cut(e.join(at("p"), [*group, "p"]).join(at("q"), [*group, "q"]).select(*group, F.col("_p").alias("p"), F.col("_q").alias("q")))
    step = lambda x, y: e.select(*group, F.col("p").alias(x), F.col("q").alias(y))
    # two steps out and two back, both over a middle node
    out = step("n1", "m").filter("n1 < m").join(step("m", "n3"), [*group, "m"]).filter("n1 < n3")
    back = step("m", "n1").filter("n1 < m").join(step("n3", "m"), [*group, "m"]).filter("n1 < n3")
    key = [*group, "n1", "n3"]
    names = lambda *c: [F.col(x + ".n").alias(x) for x in c]
    way = lambda d, there: d.select(*group, *names("n1", "n3", "m"), F.lit(there).alias("_out"))
    # a middle node may serve both ways; the ring and its reverse are then one
    walks = way(out, True).unionByName(way(back, False)).repartition(*key)
    mid = walks.groupBy(*key, "m").agg(F.bool_or("_out").alias("out"), F.bool_or(~F.col("_out")).alias("back"))
    joined = e.select(*group, F.least("p", "q").alias("n1"), F.greatest("p", "q").alias("n3")).select(*group, *names("n1", "n3")).distinct()
    x = mid.filter("out").select(*key, F.col("m").alias("n2"), F.col("back").alias("b2"))
    x = x.join(joined.withColumn("_joined", F.lit(True)), key, "left")
    y = mid.filter("back").select(*key, F.col("m").alias("n4"), F.col("out").alias("b4"))
    ring = x.join(y, key).filter("n2 <> n4 and not (b2 and b4 and n2 > n4)")
    ring = ring.select(*group, F.array_sort(F.array("n1", "n2", "n3", "n4")).alias("ring"), "_joined")
    alone = ring.filter("_joined is null").drop("_joined")
    return alone.unionByName(ring.filter("_joined").drop("_joined").distinct())


def g_tetrads(nts: DataFrame, atoms: DataFrame, most: float = 3.5) -> DataFrame:
    """Guanines in a ring, each giving N1 to O6 and N2 to N7 of the next."""
    g = nts.filter("base = 'G'").select(*RES, F.col("idx").alias("node"))
    a = atoms.filter(F.col("atom").isin("N1", "N2", "O6", "N7")).join(g, RES)
    a = a.select("entry", "node", "atom", "idx", "x", "y", "z")
    bond = lambda d, k: pairs_between(a.filter(F.col("atom") == d), a.filter(F.col("atom") == k), most, where=F.col("node_a") != F.col("node_b"))
    step = lambda d, k: bond(d, k).select("entry", F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    return rings_of_four(step("N1", "O6").join(step("N2", "N7"), ["entry", "a", "b"], "left_semi"), ["entry"])


# ---------------------------------------------------------------- stems
def stems(pairs: DataFrame, group: list[str], c1: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Pairs (group, i, j; places along the whole entry, i < j, strand_a, strand_b) with stem, pairs and tie.

    A pair goes on from the one before when the nucleotide paired just before i is that pair's i, the one paired just
    after j is its j, and the step is next, a bulge of at most 2, a 1x1, or a 2x2 whose C1' pairs lie 9 to 12 apart.
    Because a step may skip unpaired nucleotides only, each pair has at most one before it, so stems are islands."""
    ends = pairs.select(*group, F.col("i").alias("pos"), F.col("j").alias("mate")).unionByName(
        pairs.select(*group, F.col("j").alias("pos"), F.col("i").alias("mate"))
    )
    o = Ordered(ends, group, ["pos"], block_of(F.col("pos")))
    e = o.neighbour(["pos", "mate"], "prev_").neighbour(["pos"], "next_", ahead=True).done()
    e = cut(e)
    first = e.select(*group, F.col("pos").alias("i"), F.col("prev_pos").alias("pi"), F.col("prev_mate").alias("pj"))
    after = e.select(*group, F.col("pos").alias("j"), F.col("next_pos").alias("nj"))
    p = pairs.join(first, [*group, "i"]).join(after, [*group, "j"])
    prev = pairs.select(*group, F.col("i").alias("pi"), F.col("strand_a").alias("psa"), F.col("strand_b").alias("psb"))
    p = p.join(prev, [*group, "pi"], "left")
    gi, gj = F.col("i") - F.col("pi") - 1, F.col("pj") - F.col("j") - 1
    same = (F.col("psa") == F.col("strand_a")) & (F.col("psb") == F.col("strand_b")) & (F.col("nj") == F.col("pj"))
    step = ((gi == 0) & (gj <= 2)) | ((gj == 0) & (gi <= 2)) | ((gi == 1) & (gj == 1))
    p = p.withColumn("_two", (gi == 2) & (gj == 2)).withColumn("_step", same & (gj >= 0) & step).withColumn("_same", same)
    if c1 is not None:
        for k in (1, 2):
            p = p.withColumn("_x", F.col("pi") + k).withColumn("_y", F.col("pj") - k)
            side = lambda n: c1.select(*group, F.col("pos").alias(n), F.col("c1").alias("c" + n))
            p = p.join(side("_x"), [*group, "_x"], "left").join(side("_y"), [*group, "_y"], "left")
            d = snap(dist(vec("c_x"), vec("c_y")))
            p = p.withColumn("_two", F.coalesce(F.col("_two") & (d >= 9.0) & (d <= 12.0), F.lit(False))).drop("_x", "_y", "c_x", "c_y")
        p = p.withColumn("_step", F.col("_step") | (F.col("_two") & F.col("_same")))
    starts = ~F.coalesce(F.col("_step"), F.lit(False))
    p = p.drop("pi", "pj", "nj", "psa", "psb", "_two", "_same")
    out = Ordered(cut(p.withColumn("_new", starts).drop("_step")), group, ["i"], block_of(F.col("i")))
    # a stem's pairs are neighbours among its first arm's pairs, so a running count of openings names it
    s = cut(out.islands(F.col("_new"), "stem").done().drop("_new"))
    n = s.groupBy(*group, "stem").agg(F.count(F.lit(1)).alias("pairs"))
    return s.join(n, [*group, "stem"]).withColumn("tie", F.col("pairs") < least)


def crossing_items(pairs: DataFrame, group: list[str], item: str, rank: list[str]) -> DataFrame:
    """(worse, better) items of a group any of whose pairs cross. `rank` columns order items, best first, no ties."""
    p = pairs.select(*group, item, *rank, "i", "j")
    m = spans_meeting(p, p, group, "i", "j")
    worse = F.struct(*[F.col(r + "_a") for r in rank])
    better = F.struct(*[F.col(r + "_b").alias(r + "_a") for r in rank])
    cross = ((F.col("i_a") < F.col("i_b")) & (F.col("i_b") < F.col("j_a")) & (F.col("j_a") < F.col("j_b"))) | (
        (F.col("i_b") < F.col("i_a")) & (F.col("i_a") < F.col("j_b")) & (F.col("j_b") < F.col("j_a"))
    )
    m = m.filter(cross & (worse > better))
    return m.select(*group, F.col(item + "_a").alias(item), F.col(item + "_b").alias(item + "_by")).distinct()


def pseudoknots(pairs: DataFrame, group: list[str], item: str, rank: list[str]) -> DataFrame:
    """Items with `kept`: taken best first, an item that crosses one already kept is a knot."""
    clash = crossing_items(pairs, group, item, rank)
    clash = clash.select(*group, item, *[F.col(g).alias(g + "_by") for g in group], item + "_by")
    return keep_unless_beaten(pairs.select(*group, item).distinct(), clash, [*group, item])


def pair_levels(pairs: DataFrame, group: list[str], item: str, rank: list[str]) -> DataFrame:
    """Items with their bracket level: the lowest at which they cross no better item."""
    clash = crossing_items(pairs, group, item, rank)
    clash = clash.select(*group, item, *[F.col(g).alias(g + "_by") for g in group], item + "_by")
    return lowest_free_level(pairs.select(*group, item).distinct(), clash, [*group, item])


def na_runs(places: DataFrame, stem_pairs: DataFrame, group: list[str]) -> DataFrame:
    """Unpaired runs of each strand (group, strand, lo, hi, kind): tail at an end, else by the innermost nested pair
    around it and the pairs that branch off inside. `places`: group, strand, pos; `stem_pairs`: nested, i, j, same
    strand or not; ties are not stem pairs."""
    used = stem_pairs.select(*group, F.col("i").alias("pos")).union(stem_pairs.select(*group, F.col("j").alias("pos"))).distinct()
    p = places.join(used.withColumn("paired", F.lit(True)), [*group, "pos"], "left").withColumn("paired", F.coalesce("paired", F.lit(False)))
    key = [*group, "strand"]
    o = Ordered(p, key, ["pos"], block_of(F.col("pos"))).neighbour(["paired"], "prev_")
    o = o.islands(F.col("prev_paired").isNull() | (F.col("prev_paired") != F.col("paired")), "run")
    r = cut(o.done().groupBy(*key, "run", "paired").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")))
    ends = p.groupBy(*key).agg(F.min("pos").alias("s_lo"), F.max("pos").alias("s_hi"))
    r = cut(r.filter("not paired").join(ends, key).drop("paired"))
    own = places.select(*group, F.col("pos").alias("i"), F.col("strand").alias("si"))
    mate = places.select(*group, F.col("pos").alias("j"), F.col("strand").alias("sj"))
    nested = stem_pairs.join(own, [*group, "i"]).join(mate, [*group, "j"]).filter("si = sj").select(*group, F.col("si").alias("strand"), "i", "j")
    nested = cut(nested)
    around = spans_meeting(
        r.select(*key, F.col("lo").alias("i"), F.col("hi").alias("j"), "run"), nested.withColumn("run", F.lit(-1).cast("bigint")), key, "i", "j"
    ).filter("i_b < i_a and j_a < j_b")
    close = cut(around.groupBy(*key, F.col("run_a").alias("run")).agg(F.max(F.struct("i_b", "j_b")).alias("c")))
    close = close.select(*key, "run", F.col("c.i_b").alias("ci"), F.col("c.j_b").alias("cj"))
    loops = close.select(*key, "ci", "cj").distinct()
    inside = spans_meeting(
        loops.select(*key, F.col("ci").alias("i"), F.col("cj").alias("j")), nested, key, "i", "j"
    ).filter("i_a < i_b and j_b < j_a")
    # a branch is an inner pair no other inner pair encloses: its nearest enclosing pair is the closing one
    up = spans_meeting(nested, nested, key, "i", "j").filter("i_a < i_b and j_b < j_a")
    up = up.groupBy(*key, F.col("i_b").alias("i")).agg(F.max("i_a").alias("parent_i"))
    br = inside.select(*key, F.col("i_a").alias("ci"), F.col("i_b").alias("i")).join(up, [*key, "i"]).filter("parent_i = ci")
    n = br.groupBy(*key, "ci").agg(F.count(F.lit(1)).alias("branches"))
    out = r.join(close, [*key, "run"], "left").join(n, [*key, "ci"], "left")
    kind = (
        F.when((F.col("lo") == F.col("s_lo")) | (F.col("hi") == F.col("s_hi")), F.lit("tail")).when(F.col("ci").isNull(), F.lit("linker"))
        .when(F.coalesce("branches", F.lit(0)) == 0, F.lit("hairpin")).when(F.col("branches") == 1, F.lit("internal")).otherwise(F.lit("junction"))
    )
    return out.select(*key, "lo", "hi", kind.alias("kind"))


def helices_of_stems(stem_ends: DataFrame, group: list[str]) -> DataFrame:
    """Stems (group, stem, strand_a, strand_b, i0, i1, j1, j0: arms i0..i1 and j1..j0) with `helix`: a stem goes on
    inward into the nearest stem between its arms when no other stem has a nucleotide in the loop between them."""
    s = stem_ends
    loop = s.select(*group, "strand_a", "strand_b", F.col("stem").alias("outer"), (F.col("i1") + 1).alias("i"), (F.col("j1") - 1).alias("j")).filter("i <= j")
    inner = s.select(*group, "strand_a", "strand_b", "stem", "i0", "j0", F.col("i0").alias("i"), F.col("j0").alias("j"))
    at = spans_meeting(loop, inner.withColumn("outer", F.lit(None).cast("bigint")), [*group, "strand_a", "strand_b"], "i", "j")
    at = at.filter("i_b >= i_a and j_b <= j_a")
    near = at.groupBy(*group, F.col("outer_a").alias("outer"), F.col("i_a").alias("lo"), F.col("j_a").alias("hi")).agg(
        F.min(F.struct("i0", "stem", "j0")).alias("n")
    )
    near = near.select(*group, "outer", F.col("n.stem").alias("stem"), "lo", "hi", F.col("n.i0").alias("ni"), F.col("n.j0").alias("nj"))
    arms = s.select(*group, F.col("stem").alias("own"), F.col("i0").alias("i"), F.col("i1").alias("j")).union(
        s.select(*group, F.col("stem").alias("own"), F.col("j1").alias("i"), F.col("j0").alias("j"))
    )
    gaps = near.select(*group, F.col("outer").alias("own"), F.col("lo").alias("i"), (F.col("ni") - 1).alias("j")).union(
        near.select(*group, F.col("outer").alias("own"), (F.col("nj") + 1).alias("i"), F.col("hi").alias("j"))
    ).filter("i <= j")
    blocked = spans_meeting(gaps, arms, group, "i", "j").select(*group, F.col("own_a").alias("outer")).distinct()
    link = near.join(blocked, [*group, "outer"], "left_anti").select(*group, F.col("outer").alias("a"), F.col("stem").alias("b"))
    comp = components(link, group, "a", "b")
    return s.join(comp.select(*group, F.col("node").alias("stem"), "component"), [*group, "stem"], "left").withColumn(
        "helix", F.coalesce("component", "stem")
    ).drop("component")


def dominant_duplex(stem_sizes: DataFrame, group: list[str], share: float = 0.8) -> DataFrame:
    """The one straight stem between two chains that holds at least 80 % of all stem pairs of its entry."""
    total = stem_sizes.groupBy(*group).agg(F.sum("pairs").alias("total"), F.min(F.struct((-F.col("pairs")).alias("k"), "stem", "chain_a", "chain_b", "straight")).alias("b"))
    keep = (F.col("b.chain_a") != F.col("b.chain_b")) & F.col("b.straight") & (-F.col("b.k") >= F.lit(share) * F.col("total"))
    return total.filter(keep).select(*group, F.col("b.stem").alias("stem"), (-F.col("b.k")).alias("pairs"), "total")


# ---------------------------------------------------------------- text forms
def bracket(level: Column, opening: Column) -> Column:
    """The bracket of a level: () [] {} <> then letters."""
    odd = F.array(*[F.lit(c) for c in "([{<"])
    even = F.array(*[F.lit(c) for c in ")]}>"])
    upper = F.char(F.lit(61) + level)
    return F.when(level.isNull(), F.lit(".")).when(level > 3, F.when(opening, upper).otherwise(F.lower(upper))).otherwise(
        F.when(opening, F.element_at(odd, level + 1)).otherwise(F.element_at(even, level + 1))
    )


def ordered_text(df: DataFrame, group: list[str], order: str, text: str, sep: str, part: int = 4096) -> DataFrame:
    """group, part, body: the texts of a group joined in order, in parts of at most `part` rows, so no group has to
    fit in one task. Parts in order make the whole."""
    p = df.withColumn("part", F.floor((F.col(order) - 1) / F.lit(part)).cast("bigint"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return p.groupBy(*group, "part").agg(F.array_join(F.transform(rows, lambda r: r["t"]), sep).alias("body"))
