"""Symmetry of assemblies: cyclic, dihedral, cubic and helical, and the protomers it is made of; all entries at once.

A motion is judged by where it takes each copy of a protein: its centre must fall near those of a few copies (a distance join),
and the deviation of all matched residues from one of these must be small. That deviation follows from the sums of a
superposition, so residues are joined once for every pair of chains that is ever compared, however many motions compare it.
Relative motions of two copies come from the fits of the first copy on either, so there is one fit a chain, not one a pair.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.functions.geom import Vec, grid_mean, matrix_apply, screw, snap, vec, vec_cols
from molframe.operators.superpose import UVW, XYZ, fit_of_sums, fit_sums
from molframe.plans.blocks import near_pair_counts
from molframe.plans.rounds import first_by, keep_unless_beaten
from molframe.plans.spatial import pairs_between
from molframe.session import cut

WITHIN = 3.0  # RMSD of a copy from its image
MOST = 24  # highest order tried
LEAST_RESIDUES = 10
NEAREST = 3  # copies tried as the image of a copy
LEAST_TURN = 10.0  # degrees; less is a translation of a lattice
ONE_AXIS = 0.99  # cosine above which two axes are one
LEAST_RISE, LEAST_TWIST, LEAST_PATH = 2.0, 3.0, 4
PAIR = ["entry", "chain", "to"]


class Copies(NamedTuple):
    """`members`: entry, first, chain, rank, x, y, z (centre) of every chain that has a copy, `total` members of the entry;
    `points`: their residues by place; `origin`: the entry's centre, to which all coordinates are relative."""

    members: DataFrame
    points: DataFrame
    origin: DataFrame


def copies_of(residues: DataFrame, copies: DataFrame) -> Copies:
    """residues: entry, chain, seq, icode, idx, x, y, z; copies: entry, chain, first, shift (of `chain_copies`)."""
    many = copies.groupBy("entry", "first").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("entry", "first")
    c = copies.join(many, ["entry", "first"])
    r = residues.join(c, ["entry", "chain"]).withColumn("place", F.col("seq") - F.col("shift"))
    r = cut(r.select("entry", "first", "chain", "place", "icode", "idx", "x", "y", "z"))
    centre = r.groupBy("entry", "first", "chain").agg(F.min("idx").alias("rank"), F.count(F.lit(1)).alias("residues"), *[grid_mean(F.col(k)).alias(k) for k in "xyz"])
    centre = cut(centre.filter(F.col("residues") >= LEAST_RESIDUES))
    origin = cut(centre.groupBy("entry").agg(F.count(F.lit(1)).alias("total"), *[grid_mean(F.col(k)).alias("o" + k) for k in "xyz"]))
    near = [snap(F.col(k) - F.col("o" + k), 1e6).alias(k) for k in "xyz"]
    members = cut(centre.join(origin, "entry").select("entry", "first", "chain", "rank", "total", *near))
    points = cut(r.join(members.select("entry", "chain"), ["entry", "chain"], "left_semi").join(origin, "entry").select("entry", "first", "chain", "place", "icode", *near))
    return Copies(members, points, origin)


def pair_sums(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sums of superposition of the matched residues of the given pairs (entry, chain, to)."""
    left = points.select("entry", "chain", "place", "icode", *XYZ)
    right = points.select("entry", F.col("chain").alias("to"), "place", "icode", *[F.col(a).alias(b) for a, b in zip(XYZ, UVW)])
    return fit_sums(pairs.select(*PAIR).join(left, ["entry", "chain"]).join(right, ["entry", "to", "place", "icode"]), PAIR)


def deviation(r: Column, t: Vec) -> Column:
    """RMSD that the motion (r, t) leaves between the two sides of `fit_sums` columns."""
    c = F.col
    turned = matrix_apply(r, Vec(c("s_x"), c("s_y"), c("s_z")))
    cross = sum((r[3 * i + j] * c(f"s_{XYZ[j]}{UVW[i]}") for i in range(3) for j in range(3) if (i, j) != (0, 0)), r[0] * c("s_xu"))
    square = c("s_aa") + c("s_bb") + c("n") * t.dot(t) + F.lit(2.0) * (t.dot(turned) - t.dot(Vec(c("s_u"), c("s_v"), c("s_w"))) - cross)
    return snap(F.sqrt(F.greatest(square / c("n"), F.lit(0.0))), 1e6)


def relative_motions(cp: Copies, within: float = WITHIN) -> DataFrame:
    """entry, first, a, b (in file order), r, t: the motion of copy a onto copy b, for copies that fit the first within `within`."""
    heads = cp.members.groupBy("entry", "first").agg(F.min_by("chain", F.struct("rank", "chain")).alias("chain"))
    own = cp.members.select("entry", "first", F.col("chain").alias("to"), "rank")
    fits = fit_of_sums(pair_sums(cp.points, heads.join(own, ["entry", "first"])), PAIR).filter((F.col("n") >= LEAST_RESIDUES) & (F.col("rmsd") <= within))
    fits = cut(fits.join(own, ["entry", "to"]).select("entry", "first", F.col("to").alias("chain"), "rank", "r", "t"))
    side = lambda s: fits.select("entry", "first", *[F.col(c).alias(c + s) for c in ("chain", "rank", "r", "t")])
    j = side("_a").join(side("_b"), ["entry", "first"]).filter(F.struct("rank_a", "chain_a") < F.struct(F.col("rank_b").alias("rank_a"), F.col("chain_b").alias("chain_a")))
    a, b = F.col("r_a"), F.col("r_b")
    r = F.array(*[a[3 * k] * b[3 * i] + a[3 * k + 1] * b[3 * i + 1] + a[3 * k + 2] * b[3 * i + 2] for i in range(3) for k in range(3)])
    j = j.withColumn("r", r)
    t = vec("t_b").minus(matrix_apply(F.col("r"), vec("t_a")))
    return j.select("entry", "first", F.col("chain_a").alias("a"), F.col("chain_b").alias("b"), F.struct("rank_a", "rank_b").alias("order"), "r", t.struct().alias("t"))


def candidate_axes(motions: DataFrame) -> DataFrame:
    """entry, cand, axis: directions of the turns of at least ten degrees, first come, without those within about eight degrees of one
    kept. Directions equal to 0.01 are one from the start."""
    s = screw(F.col("r"), vec("t"))
    d = motions.select("entry", "order", s["axis"].alias("axis"), s["angle"].alias("angle")).filter(F.col("angle") >= LEAST_TURN)
    v = vec("axis")
    up = F.when((snap(v.z) < 0) | ((snap(v.z) == 0) & (snap(v.y) < 0)) | ((snap(v.z) == 0) & (snap(v.y) == 0) & (v.x < 0)), F.lit(-1.0)).otherwise(F.lit(1.0))
    d = d.withColumn("axis", v.times(up).struct())
    cell = F.struct(*[F.round(F.col(f"axis.{k}") * 100).cast("int").alias(k) for k in "xyz"])
    d = cut(d.groupBy("entry", cell.alias("cand")).agg(F.min("order").alias("order"), F.min_by("axis", "order").alias("axis")))
    flat = d.select("entry", F.to_json("cand").alias("cand"), "order", *[F.col(f"axis.{k}").alias(k) for k in "xyz"])
    both = flat.unionByName(flat.select("entry", "cand", "order", *[(-F.col(k)).alias(k) for k in "xyz"]))
    reach = (2 * (1 - ONE_AXIS)) ** 0.5
    worse = F.struct("order_a", "cand_a") > F.struct(F.col("order_b").alias("order_a"), F.col("cand_b").alias("cand_a"))
    clash = pairs_between(flat, both, reach, idx="cand", where=worse & (F.col("cand_a") != F.col("cand_b")))
    clash = clash.select("entry", F.col("cand_a").alias("cand"), F.col("entry").alias("entry_by"), F.col("cand_b").alias("cand_by")).distinct()
    kept = keep_unless_beaten(flat.select("entry", "cand"), clash, ["entry", "cand"]).filter("kept")
    return d.withColumn("cand", F.to_json("cand")).join(kept.select("entry", "cand"), ["entry", "cand"], "left_semi").select("entry", "cand", "order", "axis")


def turn_about(axis: Vec, degrees: Column) -> Column:
    """Row-major rotation matrix by the right hand."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    k = F.lit(1.0) - c
    x, y, z = axis
    return F.array(c + x * x * k, x * y * k - z * s, x * z * k + y * s, y * x * k + z * s, c + y * y * k, y * z * k - x * s, z * x * k - y * s, z * y * k + x * s, c + z * z * k)


def images(cp: Copies, motions: DataFrame, key: list[str], within: float = WITHIN, in_order: bool = False) -> DataFrame:
    """entry, key, chain, to, dev: the copy that each member lands on within `within` under each motion (entry, key, r, t): the one of
    the least deviation among the NEAREST by centre, or with `in_order` the first in the file. Members that land on none are left out.

    Copies whose centre is farther than four times `within` from the image are not tried."""
    at = matrix_apply(F.col("r"), vec_cols()).plus(vec("t"))
    moved = motions.join(cp.members.select("entry", "first", "chain", *XYZ), "entry")
    moved = moved.select("entry", "first", F.struct(*key).alias("key"), "chain", "r", "t", *[v.alias(k) for v, k in zip(at, XYZ)])
    near = pairs_between(cp.members.select("entry", "first", "chain", "rank", *XYZ), moved, 4.0 * within, ["entry", "first"], "chain")
    near = near.select("entry", *[F.col(k + "_b").alias(k) for k in ("key", "chain", "r", "t")], F.col("chain_a").alias("to"), F.col("rank_a").alias("rank"), "distance")
    if not in_order:
        near = first_by(near, ["entry", "key", "chain"], [F.col("distance"), F.col("rank"), F.col("to")], NEAREST, "_near")
    near = cut(near)
    sums = pair_sums(cp.points, near.select(*PAIR).distinct()).filter(F.col("n") >= LEAST_RESIDUES)
    scored = near.join(sums, PAIR).withColumn("dev", deviation(F.col("r"), vec("t"))).filter(F.col("dev") <= within)
    best = [F.col("rank"), F.col("to")] if in_order else [F.col("dev"), F.col("distance"), F.col("rank"), F.col("to")]
    return cut(first_by(scored, ["entry", "key", "chain"], best, name="_best").select("entry", "key.*", "chain", "to", "dev"))


def power(perm: DataFrame, key: list[str], times: DataFrame, top: int) -> DataFrame:
    """`times` (key, chain, times) with `end`: where the chain is after so many steps of the permutation, by doubling."""
    walk = times.withColumn("end", F.col("chain"))
    step = perm.select(*key, F.col("chain").alias("end"), F.col("to").alias("_next"))
    bit = 1
    while bit <= top:
        j = walk.join(step, [*key, "end"], "left")
        walk = cut(j.withColumn("end", F.when(F.col("times").bitwiseAND(F.lit(bit)) > 0, F.col("_next")).otherwise(F.col("end"))).drop("_next"))
        bit *= 2
        if bit <= top:
            on = step.select(*key, F.col("end").alias("_next"), F.col("_next").alias("_then"))
            step = cut(step.join(on, [*key, "_next"]).select(*key, "end", F.col("_then").alias("_next")))
    return walk


def cyclic_axes(cp: Copies, within: float = WITHIN, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(axes, images). axes: entry, cand, n, axis, worst: every axis through the centre and order n for which a turn of 360 / n takes the
    members to distinct copies, each back to itself after n turns and not before. n divides the number of members."""
    ax = candidate_axes(relative_motions(cp, within))
    key = ["entry", "cand", "n"]
    o = ax.join(cp.origin.select("entry", "total"), "entry").withColumn("n", F.explode(F.sequence(F.lit(2), F.lit(most))))
    o = o.filter(F.col("total") % F.col("n") == 0)
    zero = Vec(F.lit(0.0), F.lit(0.0), F.lit(0.0)).struct()
    o = cut(o.withColumn("r", turn_about(vec("axis"), F.lit(360.0) / F.col("n"))).withColumn("t", zero))
    im = images(cp, o.select(*key, "r", "t"), key[1:], within)
    g = im.groupBy(*key).agg(F.count(F.lit(1)).alias("k"), F.countDistinct("to").alias("d"), F.max("dev").alias("worst"))
    whole = g.join(o.select(*key, "total", "axis", "order"), key).filter("k = total and d = total")
    im = cut(im.join(whole.select(*key), key, "left_semi"))
    # orbits of n: n turns lead back, n / p turns (p a prime of n) never do
    primes = [p for p in range(2, most + 1) if all(p % q for q in range(2, p))]
    less = F.filter(F.array(*[F.lit(p) for p in primes]), lambda p: F.col("n") % p == 0)
    times = im.select(*key, "chain", F.explode(F.concat(F.array("n"), F.transform(less, lambda p: F.floor(F.col("n") / p).cast("int")))).alias("times"))
    end = power(im, key, times, most)
    bad = end.filter(F.col("end").isNull() | ((F.col("times") == F.col("n")) != (F.col("end") == F.col("chain")))).select(*key).distinct()
    whole = whole.join(bad, key, "left_anti")
    return cut(whole.select(*key, "axis", "order", "worst")), im


def _refined(cp: Copies, top: DataFrame, im: DataFrame, within: float) -> DataFrame:
    """`top` with the axis fitted to all copies at once, where that leads to the same images."""
    perm = im.join(top.select("entry", "cand", "n"), ["entry", "cand", "n"], "left_semi")
    sums = pair_sums(cp.points, perm.select(*PAIR))
    total = sums.groupBy("entry").agg(*[F.sum(c).alias(c) for c in sums.columns if c not in PAIR])
    fit = fit_of_sums(total, ["entry"])
    s = screw(F.col("r"), vec("t"))
    d = top.join(fit.select("entry", s["axis"].alias("_ax"), s["point"].alias("_p")), "entry")
    d = d.withColumn("_ax", F.when(vec("_ax").dot(vec("axis")) < 0, vec("_ax").times(-1.0).struct()).otherwise(F.col("_ax")))
    # a point of the axis at the height of the centre, which is the origin here
    p = vec("_p").minus(vec("_ax").times(vec("_p").dot(vec("_ax"))))
    d = d.withColumn("_p", p.struct()).withColumn("r", turn_about(vec("_ax"), F.lit(360.0) / F.col("n")))
    d = cut(d.withColumn("t", vec("_p").minus(matrix_apply(F.col("r"), vec("_p"))).struct()))
    new = images(cp, d.select("entry", "cand", "n", "r", "t"), ["cand", "n"], within)
    same = new.join(perm.select("entry", "cand", "n", "chain", F.col("to").alias("_to")), ["entry", "cand", "n", "chain"]).groupBy("entry").agg(
        F.count_if(F.col("to") == F.col("_to")).alias("_same"), F.max("dev").alias("_worst")
    )
    j = d.join(same, "entry", "left").join(cp.origin, "entry")
    ok = F.coalesce(F.col("_same") == F.col("total"), F.lit(False))
    o = Vec(F.col("ox"), F.col("oy"), F.col("oz"))
    point = F.when(ok, o.plus(vec("_p")).struct()).otherwise(o.struct())
    return j.select("entry", "cand", "n", F.when(ok, F.col("_ax")).otherwise(F.col("axis")).alias("axis"), point.alias("point"), F.when(ok, F.col("_worst")).otherwise(F.col("worst")).alias("rmsd"))


class Cyclic(NamedTuple):
    """`groups`: entry, symbol, n, axis, point, rmsd; `images`: entry, chain, to under one turn of 360 / n; `axes`: all that were found."""

    groups: DataFrame
    images: DataFrame
    axes: DataFrame


def cyclic_symmetry(residues: DataFrame, copies: DataFrame, within: float = WITHIN, most: int = MOST) -> Cyclic:
    """The main axis of every entry that has one: highest order, then least deviation, refined over all copies; and its symbol: C or,
    with a two-fold across it, D; two three-folds make it T, with a four-fold O, with a five-fold I."""
    cp = copies_of(residues, copies)
    axes, im = cyclic_axes(cp, within, most)
    top = cut(first_by(axes, ["entry"], [F.desc("n"), F.col("worst"), F.col("order"), F.col("cand")]).select("entry", "cand", "n", "axis", "worst"))
    groups = _refined(cp, top, im, within)
    symbols = symmetry_symbol(axes, groups)
    groups = cut(groups.join(symbols, "entry"))
    perm = cut(im.join(top.select("entry", "cand", "n"), ["entry", "cand", "n"], "left_semi").select("entry", "chain", "to"))
    return Cyclic(groups.select("entry", "symbol", "n", "axis", "point", "rmsd"), perm, axes)


def symmetry_symbol(axes: DataFrame, main: DataFrame) -> DataFrame:
    """entry, symbol from all axes (entry, cand, n, axis) and the main one (entry, n, axis)."""
    m = main.select("entry", F.col("n").alias("_top"), F.col("axis").alias("_main"))
    across = (F.col("n") == 2) & (F.abs(vec("axis").dot(vec("_main"))) < 0.15)
    each = axes.filter("n in (3, 4, 5)").groupBy("entry", "cand").agg(F.max("n").alias("fold"))
    cubic = each.groupBy("entry").agg(F.count_if(F.col("fold") == 3).alias("three"), F.count_if(F.col("fold") == 4).alias("four"), F.count_if(F.col("fold") == 5).alias("five"))
    g = axes.join(m, "entry").groupBy("entry", "_top").agg(F.count_if(across).alias("two")).join(cubic, "entry", "left")
    letter = F.when(F.col("five") > 0, "I").when(F.col("four") > 0, "O").otherwise("T")
    is_cubic = (F.coalesce("three", F.lit(0)) >= 2) & ((F.col("two") > 0) | (F.col("_top") >= 3))
    return g.select("entry", F.when(is_cubic, letter).otherwise(F.concat(F.when(F.col("two") > 0, "D").otherwise("C"), F.col("_top").cast("string"))).alias("symbol"))


# ---------------------------------------------------------------- screws
def helical_symmetry(residues: DataFrame, copies: DataFrame, within: float = WITHIN, least: int = LEAST_PATH) -> tuple[DataFrame, DataFrame]:
    """(groups: entry, twist, rise, hand, copies, paths, axis, point; steps: entry, chain, to, path, place): the screw that chains all
    members in equal paths of at least `least` copies; the longest paths win, then the smallest rise. A left-handed screw has
    a negative twist. Screws of all pairs of copies are tried, equal ones (0.5 degrees, 0.25 along, 0.02 and 0.5 of the axis) once."""
    cp = copies_of(residues, copies)
    m = relative_motions(cp, within)
    s = screw(F.col("r"), vec("t"))
    d = m.select("entry", "order", "r", "t", s["axis"].alias("axis"), s["angle"].alias("angle"), s["rise"].alias("rise"), s["point"].alias("point"))
    d = d.filter((F.abs("rise") >= LEAST_RISE) & (F.col("angle") >= LEAST_TWIST))
    back = F.col("rise") < 0
    d = d.withColumn("twist", F.when(back, -F.col("angle")).otherwise(F.col("angle"))).withColumn("axis", F.when(back, vec("axis").times(-1.0).struct()).otherwise(F.col("axis"))).withColumn("rise", F.abs("rise"))
    whole = lambda c, k: F.round(c * k).cast("bigint").cast("string")
    cell = F.concat_ws("/", whole(F.col("twist"), 2), whole(F.col("rise"), 4), *[whole(F.col(f"axis.{k}"), 50) for k in "xyz"], *[whole(F.col(f"point.{k}"), 2) for k in "xyz"])
    row = F.struct("r", "t", "axis", "twist", "rise", "point")
    d = d.groupBy("entry", cell.alias("cand")).agg(F.min("order").alias("order"), F.min_by(row, "order").alias("m"))
    d = cut(d.select("entry", "cand", "order", "m.*"))
    key = ["entry", "cand"]
    step = images(cp, d.select(*key, "r", "t"), ["cand"], within, in_order=True)
    every = d.select(*key).join(cp.members.select("entry", "chain", "total"), "entry")
    hit = step.select(*key, F.col("to").alias("chain")).groupBy(*key, "chain").agg(F.count(F.lit(1)).alias("_in"))
    ends = every.join(hit, [*key, "chain"], "left").join(step.select(*key, "chain", "to"), [*key, "chain"], "left")
    # one way in at most, one start a path, no circle: as many steps as members less starts, and all reached from the starts
    g = ends.groupBy(*key, "total").agg(F.count_if(F.col("_in").isNull()).alias("paths"), F.max(F.coalesce("_in", F.lit(0))).alias("most_in"), F.count("to").alias("steps"))
    ok = g.filter((F.col("paths") > 0) & (F.col("most_in") <= 1) & (F.col("steps") == F.col("total") - F.col("paths")))
    ok = ok.filter((F.col("total") % F.col("paths") == 0) & (F.col("total") / F.col("paths") >= least))
    left = cut(ends.join(ok.select(*key, "paths"), key).select(*key, "chain", "to", F.col("_in").isNull().alias("_start"), (F.col("total") / F.col("paths")).cast("int").alias("copies"), "paths"))
    # distance from the end of the path by doubling; a circle never gets one
    walk = cut(left.select(*key, "chain", F.col("to").alias("_to"), F.when(F.col("to").isNull(), 0).otherwise(1).alias("_d"), F.col("chain").alias("_last"), "copies").withColumn("_last", F.coalesce("_to", "_last")))
    most = left.agg(F.max("copies")).first()[0] or 1
    span = 1
    while span < most:
        on = walk.select(*key, F.col("chain").alias("_last"), F.col("_d").alias("_more"), F.col("_last").alias("_on"))
        j = walk.join(on, [*key, "_last"])
        walk = cut(j.select(*key, "chain", (F.col("_d") + F.col("_more")).alias("_d"), F.col("_on").alias("_last"), "copies"))
        span *= 2
    w = walk.join(left.select(*key, "chain", "to", "_start"), [*key, "chain"])
    even = w.groupBy(*key, "copies").agg(F.bool_and(~F.col("_start") | (F.col("_d") == F.col("copies") - 1)).alias("_even")).filter("_even")
    best = first_by(even.join(d, key), ["entry"], [F.desc("copies"), F.col("rise"), F.col("order"), F.col("cand")])
    best = cut(best.join(ok.select(*key, "paths"), key).join(cp.origin, "entry"))
    o = Vec(F.col("ox"), F.col("oy"), F.col("oz"))
    hand = F.when(F.abs("twist") > 170.0, F.lit("none")).when(F.col("twist") < 0, "left").otherwise("right")
    groups = best.select("entry", snap(F.col("twist")).alias("twist"), snap(F.col("rise")).alias("rise"), hand.alias("hand"), "copies", "paths", "axis", o.plus(vec("point")).struct().alias("point"))
    steps = w.join(best.select(*key), key, "left_semi").select("entry", "chain", "to", F.col("_last").alias("path"), (F.col("copies") - 1 - F.col("_d")).alias("place"))
    return cut(groups), cut(steps)


# ---------------------------------------------------------------- protomers
def orbits(images_: DataFrame) -> DataFrame:
    """entry, chain, orbit: the least chain name that repeated turns lead to, by doubling."""
    walk = cut(images_.select("entry", "chain", "to", F.least("chain", "to").alias("orbit")))
    while True:
        on = walk.select("entry", F.col("chain").alias("to"), F.col("orbit").alias("_o"), F.col("to").alias("_to"))
        new = walk.join(on, ["entry", "to"])
        new = cut(new.select("entry", "chain", F.col("_to").alias("to"), F.least("orbit", "_o").alias("orbit"), (F.col("_o") < F.col("orbit")).alias("_m")))
        if new.filter("_m").isEmpty():
            return new.select("entry", "chain", "orbit")
        walk = new.drop("_m")


def protomers(residues: DataFrame, copies: DataFrame, found: Cyclic, reach: float = 8.0) -> DataFrame:
    """entry, protomer (from 0), chain, orbit. Protomer 0 takes one chain of each orbit, in order of cluster and name: the first one's
    first chain, then the chain with most CA pairs within 8 to those already taken, the last name on a tie. Protomer k holds
    its k-th images. One orbit is settled a round, of all entries together."""
    o = orbits(found.images).join(copies.select("entry", "chain", "first"), ["entry", "chain"])
    start = residues.groupBy("entry", "chain").agg(F.min("idx").alias("rank"))
    order = o.select("entry", "orbit", "first").distinct().join(start.select("entry", F.col("chain").alias("first"), "rank"), ["entry", "first"])
    order = order.withColumn("turn", F.row_number().over(Window.partitionBy("entry").orderBy("rank", "orbit")))
    o = cut(o.join(order.select("entry", "orbit", "turn"), ["entry", "orbit"]).select("entry", "chain", "orbit", "turn"))
    held = residues.join(o.select("entry", "chain"), ["entry", "chain"], "left_semi")
    n = cut(near_pair_counts(held.select("entry", "chain", "idx", "x", "y", "z"), reach, "chain").withColumnRenamed("pairs", "n"))
    n = n.select("entry", F.col("chain_a").alias("chain"), F.col("chain_b").alias("by"), "n").unionByName(n.select("entry", F.col("chain_b").alias("chain"), F.col("chain_a").alias("by"), "n"))
    taken = cut(o.filter("turn = 1 and chain = orbit").select("entry", "chain", "orbit"))
    for turn in range(2, (o.agg(F.max("turn")).first()[0] or 1) + 1):
        now = o.filter(F.col("turn") == turn)
        touch = now.join(n, ["entry", "chain"]).join(taken.select("entry", F.col("chain").alias("by")), ["entry", "by"]).groupBy("entry", "chain").agg(F.sum("n").alias("k"))
        now = now.join(touch, ["entry", "chain"], "left").groupBy("entry", "orbit").agg(F.max(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "chain")).alias("b"))
        taken = cut(taken.unionByName(now.select("entry", F.col("b.chain").alias("chain"), "orbit")))
    k = found.groups.select("entry", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("times"))
    top = found.groups.agg(F.max("n")).first()[0] or 1
    return power(found.images, ["entry"], taken.join(k, "entry"), top).select("entry", F.col("times").alias("protomer"), F.col("end").alias("chain"), "orbit")


def given_protomers(residues: DataFrame, copies: DataFrame, grouping: DataFrame) -> DataFrame:
    """entry, symbol, n, twist, rise, rmsd of a user's own grouping (entry, protomer from 0, place, chain): the first protomer is fitted
    on the second, chain by chain. It is helical (H) where that rises by 2 or more and turns more than 15 degrees other than 360 / n."""
    cp = copies_of(residues, copies)
    side = lambda k, name: grouping.filter(F.col("protomer") == k).select("entry", "place", F.col("chain").alias(name))
    pairs = side(0, "chain").join(side(1, "to"), ["entry", "place"])
    sums = pair_sums(cp.points, pairs)
    fit = fit_of_sums(sums.groupBy("entry").agg(*[F.sum(c).alias(c) for c in sums.columns if c not in PAIR]), ["entry"])
    n = grouping.groupBy("entry").agg(F.countDistinct("protomer").alias("n"))
    s = screw(F.col("r"), vec("t"))
    d = fit.select("entry", "rmsd", s["angle"].alias("angle"), s["rise"].alias("rise")).join(n, "entry")
    helical = (F.abs("rise") >= LEAST_RISE) & (F.abs(F.col("angle") - F.lit(360.0) / F.col("n")) > 15.0)
    twist = F.when(F.col("rise") < 0, -F.col("angle")).otherwise(F.col("angle"))
    return d.select("entry", F.when(helical, F.lit("H")).otherwise(F.concat(F.lit("C"), F.col("n").cast("string"))).alias("symbol"), "n",
                    F.when(helical, snap(twist)).alias("twist"), F.when(helical, snap(F.abs("rise"))).alias("rise"), snap(F.col("rmsd")).alias("rmsd"))
