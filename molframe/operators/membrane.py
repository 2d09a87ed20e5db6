"""Where the membrane lies: depth of elements, the sliding slab, refits, sides, barrels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.functions import chemistry as chem
from molframe.functions.geom import Vec, pseudo_cb, snap, vec, vec_angle, vec_cols
from molframe.functions.linalg import eig3, solve5
from molframe.plans.ranks import quantiles
from molframe.plans.rounds import first_by
from molframe.session import cut

HALF = 15.0
FACE = 2.0
INTERFACE = 7.5


def crosses(lo: Column, hi: Column, half: Column) -> Column:
    """The run passes the mid-plane and spans at least half the thickness."""
    return (lo < 0.0) & (hi > 0.0) & (snap(hi - lo) >= half)


def with_depth(residues: DataFrame, normal: Vec, centre: Column) -> DataFrame:
    return residues.withColumn("depth", snap(vec_cols().dot(normal) - centre))


def element_depths(residues: DataFrame, normal: Vec, centre: Column, half: Column) -> DataFrame:
    """Depth range of each element, whether it spans the slab or crosses its middle, its side and its ends' sides."""
    d = with_depth(residues, normal, centre).withColumn("half", half)
    out = d.groupBy("entry", "element").agg(
        F.min("depth").alias("depth_min"), F.max("depth").alias("depth_max"), F.avg("depth").alias("_mid"),
        F.min_by("depth", "idx").alias("_a"), F.max_by("depth", "idx").alias("_b"), F.first("half").alias("half"),
        F.count(F.lit(1)).alias("_n"),
    )
    h = F.col("half")
    many = F.col("_n") >= 2
    spans = many & (F.col("depth_min") <= -h + FACE) & (F.col("depth_max") >= h - FACE)
    cross = many & crosses(F.col("depth_min"), F.col("depth_max"), h)
    sign = lambda c: F.when(F.col(c) >= 0, F.lit("out")).otherwise(F.lit("in"))
    mid = snap(F.col("_mid"))
    side = F.when(cross, F.lit("across")).when(mid >= h, F.lit("out")).when(mid <= -h, F.lit("in")).otherwise(F.lit("slab"))
    return out.select("entry", "element", "depth_min", "depth_max", spans.alias("spans_slab"), cross.alias("crosses_midplane"),
                      side.alias("side"), sign("_a").alias("side_from"), sign("_b").alias("side_to"))


def element_class(residues: DataFrame, normal: Vec, centre: Column, half: Column, axes: DataFrame | None = None) -> DataFrame:
    """Per element: crosses, in the slab (median inside, not crossing), at a face, flat, own side and one-sided bound."""
    d = with_depth(residues, normal, centre)
    m = quantiles(d, ["entry", "element"], "depth", {"median": 0.5, "lo": 0.0, "hi": 1.0})
    mean = d.groupBy("entry", "element").agg(F.avg("depth").alias("_m"))
    out = m.join(mean, ["entry", "element"]).withColumn("half", half).withColumn("mid", snap(F.col("_m")))
    h = F.col("half")
    cross = (F.col("n") >= 2) & crosses(F.col("lo"), F.col("hi"), h)
    face = snap(F.abs(F.abs(F.col("mid")) - h)) <= INTERFACE
    out = out.withColumn("crosses", cross).withColumn("in_slab", ~cross & (F.abs("median") < h)).withColumn("at_face", face)
    side = F.when(F.col("mid") >= 0, F.lit(1)).otherwise(F.lit(-1))
    bound = F.when(side == 1, F.col("lo")).otherwise(-F.col("hi"))
    out = out.withColumn("side", F.when(side == 1, F.lit("out")).otherwise(F.lit("in"))).withColumn("bound", bound)
    if axes is not None:
        along = snap(F.abs(vec("axis").unit().dot(normal)))
        limit = F.when(F.col("at_face"), snap(F.cos(F.radians(F.lit(35.0))))).otherwise(snap(F.cos(F.radians(F.lit(45.0)))))
        out = out.join(axes, ["entry", "element"], "left").withColumn("flat", ~F.col("crosses") & (along <= limit)).drop("axis")
    return out.drop("_m", "half", "n")


# ---------------------------------------------------------------- the sliding slab
def slab_scores(residues: DataFrame, group: list[str], half: float = HALF, least: int = 20) -> DataFrame:
    """Every slab centre on the 1 A grid with its residues, oily and polar counts. A residue (depth, is_oily,
    is_polar) goes to the 2*half centres around it, then one aggregate."""
    lo = F.floor(F.col("depth") - half).cast("bigint") + 1
    hi = F.ceil(F.col("depth") + half).cast("bigint") - 1
    c = residues.withColumn("centre", F.explode(F.sequence(lo, hi)))
    s = c.groupBy(*group, "centre").agg(
        F.count(F.lit(1)).alias("residues"), F.count_if("is_oily").alias("n_oily"), F.count_if("is_polar").alias("n_polar")
    )
    return s.filter(F.col("residues") >= least).withColumn("score", F.col("n_oily") - F.lit(1.5) * F.col("n_polar"))


def best_slab(residues: DataFrame, group: list[str], half: float = HALF, least: int = 20) -> DataFrame:
    """The best-scoring slab of each group, the lowest centre on a tie, with its oily and polar shares."""
    s = slab_scores(residues, group, half, least)
    top = s.groupBy(*group).agg(F.min(F.struct((-F.col("score")).alias("k"), "centre", "residues", "n_oily", "n_polar")).alias("b"))
    n = F.col("b.residues").cast("double")
    return top.select(*group, F.col("b.centre").alias("centre"), F.col("b.residues").alias("residues"),
                      (-F.col("b.k")).alias("score"), (F.col("b.n_oily") / n).alias("oily"), (F.col("b.n_polar") / n).alias("polar"))


def _axis_normal(elements: DataFrame) -> DataFrame:
    """Common axis of the elements of each entry: top eigenvector of the length-weighted sum of axis outer products."""
    a = vec("axis")
    w = F.col("residues")
    outer = [F.sum(w * p * q) for p, q in ((a.x, a.x), (a.x, a.y), (a.x, a.z), (a.y, a.y), (a.y, a.z), (a.z, a.z))]
    g = elements.groupBy("entry").agg(F.array(*outer).alias("_m")).withColumn("_e", eig3("_m"))
    v = F.col("_e.vectors")
    return g.select("entry", F.struct(v[6].alias("x"), v[7].alias("y"), v[8].alias("z")).alias("normal"))


def _mean_axis(helices: DataFrame, planes: DataFrame) -> DataFrame:
    h = helices.join(planes.select("entry", "normal"), "entry")
    turned = F.when(vec("axis").dot(vec("normal")) >= 0, F.col("residues")).otherwise(-F.col("residues"))
    a = vec("axis").times(turned)
    s = h.groupBy("entry").agg(F.sum(a.x).alias("x"), F.sum(a.y).alias("y"), F.sum(a.z).alias("z"))
    return s.select("entry", vec_cols().unit().struct().alias("normal"))


def _spread_of(residues: DataFrame, planes: DataFrame) -> DataFrame:
    """Residue depths along each entry's normal, from the normal's origin."""
    return residues.join(planes.select("entry", "normal"), "entry").withColumn("depth", snap(vec_cols().dot(vec("normal"))))


def estimate_slab(residues: DataFrame, elements: DataFrame, planes: DataFrame) -> DataFrame:
    """entry, normal, centre where the best slab is membrane: crossed by a long element, oily and uncharged enough
    over the residues of the chains that cross it. `residues`: entry, chain, element, resname, idx, x, y, z.

    Slab centres are the integers here; a slab that a long element spans face to face is preferred when the best one
    has none."""
    d = _spread_of(residues, planes)
    d = d.withColumn("is_oily", F.col("resname").isin(chem.OILY)).withColumn("is_polar", F.col("resname").isin(chem.POLAR))
    d = cut(d)
    slabs = slab_scores(d, ["entry"])
    reach = d.filter("element is not null").groupBy("entry", "element").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    long = elements.filter("(kind = 'H' and residues >= 16) or (kind = 'E' and residues >= 8)")
    reach = reach.join(long.select("entry", "element", "chain"), ["entry", "element"])
    s = slabs.join(reach, "entry").filter((F.col("lo") < F.col("centre") - 10.0) & (F.col("hi") > F.col("centre") + 10.0))
    spans = (F.col("lo") <= F.col("centre") - HALF + FACE) & (F.col("hi") >= F.col("centre") + HALF - FACE)
    s = s.groupBy("entry", "centre", "score", "chain").agg(F.count(F.lit(1)).alias("k"), F.max(spans.cast("int")).alias("sp"))
    total = s.groupBy("entry", "centre").agg(F.sum("k").alias("crossing"), F.max("sp").alias("spanned"))
    lo = F.floor(F.col("depth") - HALF).cast("bigint") + 1
    hi = F.ceil(F.col("depth") + HALF).cast("bigint") - 1
    held = d.withColumn("centre", F.explode(F.sequence(lo, hi))).join(s.select("entry", "centre", "score", "chain"), ["entry", "centre", "chain"])
    held = held.groupBy("entry", "centre", "score").agg(
        F.avg(F.col("is_oily").cast("double")).alias("oily"), F.avg(F.col("is_polar").cast("double")).alias("polar")
    ).join(total, ["entry", "centre"])
    like = (F.col("oily") >= 0.55) & (F.col("polar") <= F.when(F.col("crossing") >= 10, 0.20).otherwise(0.15))
    top = slabs.groupBy("entry").agg(F.min(F.struct((-F.col("score")).alias("k"), "centre")).alias("b")).select("entry", F.col("b.centre").alias("best"))
    h = held.join(top, "entry").withColumn("like", like)
    is_best = F.col("centre") == F.col("best")
    best_spans = h.groupBy("entry").agg(F.max(F.when(is_best, F.col("spanned")).otherwise(0)).alias("ok"))
    h = h.join(best_spans, "entry").filter("like and (centre = best or (ok = 0 and spanned = 1))")
    rank = [F.when((F.col("ok") == 0) & (F.col("spanned") == 1), 0).otherwise(1), -F.col("score"), F.col("centre")]
    pick = first_by(h, ["entry"], rank).select("entry", F.col("centre").cast("double").alias("centre"), "oily", "polar", "crossing")
    return pick.join(planes.select("entry", "normal"), "entry")


def membrane_refit(residues: DataFrame, elements: DataFrame, rounds: int = 8) -> DataFrame:
    """Estimate, then fit the normal to the helices crossing it, slab again, until those helices repeat.

    An entry leaves the loop when fewer than three helices cross, when a refit is no membrane, or when the set is the
    one it was fitted to. One plane per entry is returned, with `fit` the number of refits taken."""
    long = elements.filter("(kind = 'H' and residues >= 16) or (kind = 'E' and residues >= 8)")
    plane = cut(estimate_slab(residues, elements, _axis_normal(long)).withColumn("fit", F.lit(0)))
    helices = elements.filter("kind in ('H', 'G')")

    def crossing(planes: DataFrame) -> DataFrame:
        d = residues.join(planes.select("entry", "normal", "centre"), "entry")
        d = d.withColumn("depth", snap(vec_cols().dot(vec("normal")) - F.col("centre"))).filter("element is not null")
        r = d.groupBy("entry", "element").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.count(F.lit(1)).alias("n"))
        r = r.filter((F.col("n") >= 2) & crosses(F.col("lo"), F.col("hi"), F.lit(HALF)))
        return r.join(helices, ["entry", "element"]).select("entry", "element", "residues", "axis")

    open_ = cut(crossing(plane))
    done: DataFrame | None = None
    for k in range(1, rounds + 1):
        n = open_.groupBy("entry").agg(F.count(F.lit(1)).alias("c")).filter("c >= 3").select("entry")
        going = plane.join(n, "entry", "left_semi")
        stay = plane.join(n, "entry", "left_anti")
        new = estimate_slab(residues, elements, _mean_axis(open_.join(n, "entry", "left_semi"), going)).withColumn("fit", F.lit(k))
        new = cut(new)
        again = cut(crossing(new))
        enough = again.groupBy("entry").agg(F.count(F.lit(1)).alias("c")).filter("c >= 3").select("entry")
        taken = new.join(enough, "entry", "left_semi")
        stay = stay.unionByName(going.join(taken, "entry", "left_anti"), allowMissingColumns=True)
        key = ["entry", "element"]
        differ = again.select(*key).exceptAll(open_.select(*key)).union(open_.select(*key).exceptAll(again.select(*key))).select("entry").distinct()
        stay = stay.unionByName(taken.join(differ, "entry", "left_anti"), allowMissingColumns=True)
        done = cut(stay if done is None else done.unionByName(stay, allowMissingColumns=True))
        plane = cut(taken.join(differ, "entry", "left_semi"))
        open_ = cut(again.join(plane, "entry", "left_semi"))
        if plane.isEmpty():
            return done
    return done.unionByName(plane, allowMissingColumns=True)


def membrane_sides(residues: DataFrame, loops: DataFrame, planes: DataFrame, copies: DataFrame) -> DataFrame:
    """Which way is out: fewer Lys and Arg on the flanking loops within 15 of a face, the mean over copies, summed over
    proteins; on a tie all residues near the faces. `loops`: entry, chain, idx; `copies`: entry, chain, first."""
    basic = residues.filter(F.col("resname").isin("LYS", "ARG")).join(planes, "entry")
    basic = basic.withColumn("depth", snap(vec_cols().dot(vec("normal")) - F.col("centre"))).withColumn("half", F.lit(HALF))
    h, d = F.col("half"), F.col("depth")
    on = basic.join(loops.select("entry", "chain", "idx").distinct(), ["entry", "chain", "idx"], "left_semi")
    per = on.groupBy("entry", "chain").agg(
        F.count_if((d > h) & (d < h + 15.0)).alias("up"), F.count_if((d < -h) & (d > -h - 15.0)).alias("down")
    )
    mean = copies.join(per, ["entry", "chain"], "left").groupBy("entry", "first").agg(
        F.avg(F.coalesce("up", F.lit(0))).alias("up"), F.avg(F.coalesce("down", F.lit(0))).alias("down")
    )
    loop = mean.groupBy("entry").agg(snap(F.sum("up")).alias("up"), snap(F.sum("down")).alias("down"))
    every = basic.groupBy("entry").agg(
        F.count_if((d > h - 5) & (d < h + 15.0)).alias("up_all"), F.count_if((d < -h + 5) & (d > -h - 15.0)).alias("down_all")
    )
    s = planes.select("entry").join(loop, "entry", "left").join(every, "entry", "left").fillna(0)
    clear = lambda a, b: (F.greatest(a, b) >= F.lit(2.0) * F.least(a, b)) & (F.abs(F.col(a) - F.col(b)) >= 3)
    flip = F.when(F.col("up") != F.col("down"), F.col("up") > F.col("down")).otherwise(F.col("up_all") > F.col("down_all"))
    sided = clear("up", "down") | (clear("up_all", "down_all") & ((F.col("up_all") > F.col("down_all")) == flip))
    return s.select("entry", "up", "down", "up_all", "down_all", flip.alias("flip"), sided.alias("sided"))


# ---------------------------------------------------------------- outer-membrane barrels
def cylinder(points: DataFrame, group: list[str], rounds: int = 12) -> DataFrame:
    """Axis and point of the cylinder through each group's CA atoms, by Gauss-Newton rounds. `points`: x, y, z and a
    first `axis`. The normal equations of a round are one aggregate per group; only the 5x5 solve is in a batch."""
    c = F.col
    mean = points.groupBy(*group).agg(*[F.avg(k).alias("m" + k) for k in "xyz"], F.first("axis").alias("axis"))
    state = cut(mean.select(*group, Vec(c("mx"), c("my"), c("mz")).struct().alias("point"), vec("axis").unit().struct().alias("axis"), F.lit(8.0).alias("radius")))
    p = points.select(*group, "x", "y", "z")
    for _ in range(rounds):
        q = p.join(state, group)
        a, o = vec("axis"), vec("point")
        flat = F.abs(a.x) < 0.9
        helper = Vec(F.when(flat, 1.0).otherwise(0.0), F.when(flat, 0.0).otherwise(1.0), F.lit(0.0))
        e1 = a.cross(helper).unit()
        e2 = a.cross(e1)
        v = vec_cols().minus(o)
        along = v.dot(a)
        rad = v.minus(a.times(along))
        dist = F.greatest(rad.norm(), F.lit(1e-6))
        u = rad.times(F.lit(1.0) / dist)
        # residual = distance from axis - radius; derivatives by the shift and tilt along e1, e2 and by the radius
        jac = [-(u.dot(e1)), -(u.dot(e2)), -(along * u.dot(e1)), -(along * u.dot(e2)), F.lit(-1.0)]
        res = dist - c("radius")
        rows = q.select(*group, *[j.alias(f"j{i}") for i, j in enumerate(jac)], res.alias("res"), e1.struct().alias("e1"), e2.struct().alias("e2"), "point", "axis", "radius")
        sums = [F.sum(c(f"j{i}") * c(f"j{k}")) for i in range(5) for k in range(5)] + [-F.sum(c(f"j{i}") * c("res")) for i in range(5)]
        s = rows.groupBy(*group).agg(F.array(*sums).alias("_ab"), *[F.first(k).alias(k) for k in ("e1", "e2", "point", "axis", "radius")])
        s = s.withColumn("d", solve5("_ab"))
        d = c("d")
        point = vec("point").plus(vec("e1").times(d[0])).plus(vec("e2").times(d[1]))
        axis = vec("axis").plus(vec("e1").times(d[2])).plus(vec("e2").times(d[3])).unit()
        state = cut(s.select(*group, point.struct().alias("point"), axis.struct().alias("axis"), (c("radius") + d[4]).alias("radius")))
    return state


def membrane_barrel(residues: DataFrame, group: list[str] = ("entry", "barrel"), half: float = 12.0) -> DataFrame:
    """The outer membrane around each closed barrel: `residues` of its strands with n, ca, c (structs), resname, axis.

    Returns the axis, the centre of the best slab and the oily and charged shares of its outward residues; `taken`
    when at least 0.6 oily and at most 0.15 charged."""
    g = list(group)
    ca = vec("ca")
    pts = residues.select(*g, ca.x.alias("x"), ca.y.alias("y"), ca.z.alias("z"), "axis")
    cyl = cylinder(pts, g).withColumnRenamed("axis", "normal")
    r = residues.drop("axis").join(cyl, g)
    v = ca.minus(vec("point"))
    n = vec("normal")
    radial = v.minus(n.times(v.dot(n)))
    out = pseudo_cb(vec("n"), ca, vec("c")).minus(ca).dot(radial) > 0
    r = r.withColumn("z", snap(ca.dot(n))).withColumn("out", out)
    r = r.withColumn("oily", F.col("resname").isin(chem.OILY + ["TYR", "GLY"]) & F.col("out"))
    r = r.withColumn("charged", F.col("resname").isin("LYS", "ARG", "ASP", "GLU") & F.col("out"))
    r = r.withColumn("ring", F.col("resname").isin("TYR", "TRP") & F.col("out"))
    lo = F.floor(F.col("z") - half - 4.0).cast("bigint")
    hi = F.ceil(F.col("z") + half + 4.0).cast("bigint")
    c = r.withColumn("centre", F.explode(F.sequence(lo, hi)))
    off = F.abs(F.col("z") - F.col("centre"))
    inside, girdle = off < half, F.abs(off - half) < 4.0
    s = c.groupBy(*g, "centre").agg(
        F.count_if(inside & F.col("out")).alias("facing"), F.count_if(inside & F.col("oily")).alias("n_oily"),
        F.count_if(inside & F.col("charged")).alias("n_charged"), F.count_if(girdle & F.col("ring")).alias("n_girdle"),
    ).filter("facing >= 10")
    score = F.col("n_oily") - F.lit(1.5) * F.col("n_charged") + F.col("n_girdle")
    b = s.groupBy(*g).agg(F.min(F.struct((-score).alias("k"), "centre", "facing", "n_oily", "n_charged")).alias("b"))
    b = b.select(*g, F.col("b.centre").cast("double").alias("centre"), (F.col("b.n_oily") / F.col("b.facing")).alias("oily"),
                 (F.col("b.n_charged") / F.col("b.facing")).alias("charged"))
    taken = (F.col("oily") >= 0.6) & (F.col("charged") <= 0.15)
    return b.join(cyl.select(*g, "normal", "point", "radius"), g).withColumn("taken", taken)


def tilt(axis: Vec, normal: Vec) -> Column:
    """Degrees between an element's axis and the normal, either way up."""
    a = vec_angle(axis, normal)
    return F.least(a, F.lit(180.0) - a)
