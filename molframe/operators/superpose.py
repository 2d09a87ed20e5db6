"""Least-squares superposition of matched points, per group: the sums on Spark, the 3x3 algebra in batches.

`pairs` has x, y, z (moved) and u, v, w (fixed). A fit is r (row-major) and t with (u, v, w) = r (x, y, z) + t.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.functions.geom import Vec, d0, matrix_apply, rotation_angle, snap, tm_term, vec, vec_cols
from molframe.functions.linalg import svd3
from molframe.plans.ranks import quantiles
from molframe.session import cut

XYZ, UVW = "xyz", "uvw"
ROUNDS = 20


def fit_sums(pairs: DataFrame, group: list[str]) -> DataFrame:
    """The sums a fit needs, one row a group, combined map-side."""
    c = F.col
    one = [F.sum(c(k)).alias("s_" + k) for k in XYZ + UVW]
    two = [F.sum(c(a) * c(b)).alias("s_" + a + b) for a in XYZ for b in UVW]
    sq = lambda names: sum((c(k) * c(k) for k in names[1:]), c(names[0]) * c(names[0]))
    return pairs.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), *one, *two, F.sum(sq(XYZ)).alias("s_aa"), F.sum(sq(UVW)).alias("s_bb")
    )


def kabsch(pairs: DataFrame, group: list[str]) -> DataFrame:
    """group, n, r (nine numbers), t (x y z), rmsd."""
    return fit_of_sums(fit_sums(pairs, group), group)


def fit_of_sums(s: DataFrame, group: list[str]) -> DataFrame:
    """The fit that follows from the sums of `fit_sums`, which may have been added up over groups."""
    n = F.col("n")
    cov = F.array(*[F.col(f"s_{a}{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / n for a in XYZ for b in UVW])
    norm = lambda names, total: F.col(total) - sum((F.col("s_" + k) * F.col("s_" + k) for k in names[1:]), F.col("s_" + names[0]) * F.col("s_" + names[0])) / n
    f = s.withColumn("_f", svd3(cov))
    r = F.col("_f.r")
    mean = lambda names: Vec(*[F.col("s_" + k) / n for k in names])
    t = mean(UVW).minus(matrix_apply(r, mean(XYZ)))
    left = (norm(XYZ, "s_aa") + norm(UVW, "s_bb") - F.lit(2.0) * F.col("_f.s")) / n
    return f.select(*group, "n", r.alias("r"), t.struct().alias("t"), F.sqrt(F.greatest(left, F.lit(0.0))).alias("rmsd"))


def pair_distance(r: Column, t: Column) -> Column:
    """Distance left after the fit, on the 1/1024 grid."""
    at = matrix_apply(r, vec_cols()).plus(vec(t))
    d = at.minus(vec_cols("u", "v", "w"))
    return snap(d.norm(), 1024.0)


def core_fit(pairs: DataFrame, group: list[str], idx: str, length: str, factor: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(fits, pairs with kept and displacement): fit, keep the pairs within d0(length), refit until the kept set
    repeats. All groups go through a round together; a group that is done keeps its set."""
    p = pairs.withColumn("_limit", F.lit(factor) * d0(F.col(length))).withColumn("kept", F.lit(True))
    p = cut(p.withColumn("_done", F.lit(False)))
    for _ in range(ROUNDS):
        fit = kabsch(p.filter("kept"), group).select(*group, "r", "t")
        near = p.join(fit, group).withColumn("_near", pair_distance(F.col("r"), F.col("t")) <= F.col("_limit")).drop("r", "t")
        near = cut(near)
        stop = near.groupBy(*group).agg(
            ((F.count_if("_near") < 3) | (F.count_if(F.col("_near") != F.col("kept")) == 0)).alias("_stop")
        )
        p = near.join(stop, group).withColumn("_done", F.col("_done") | F.col("_stop"))
        p = cut(p.withColumn("kept", F.when(F.col("_done"), F.col("kept")).otherwise(F.col("_near"))).drop("_near", "_stop"))
        if p.filter("not _done").isEmpty():
            break
    fits = cut(kabsch(p.filter("kept"), group))
    out = p.join(fits.select(*group, "r", "t"), group)
    out = out.withColumn("displacement", pair_distance(F.col("r"), F.col("t"))).drop("r", "t", "_limit", "_done")
    return fits, out


def tm_search(pairs: DataFrame, group: list[str], idx: str, length: str, step: int = 40) -> DataFrame:
    """Best TM score per group over the starts (all pairs, then halves to thirty-seconds every `step` pairs), each
    refitted within d0_search until its selection repeats. `idx` numbers the pairs of a group from 0."""
    size = pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    frag = F.array(*[F.floor(F.col("_n") / F.lit(2**k)).cast("int") for k in range(0, 6)])
    starts = size.withColumn("_size", F.explode(F.array_distinct(frag))).filter("_size >= 4 or _size = _n")
    starts = starts.withColumn("_lo", F.explode(F.sequence(F.lit(0), (F.col("_n") - F.col("_size")).cast("int"), F.lit(step))))
    p = pairs.join(starts, group).withColumn("sel", (F.col(idx) >= F.col("_lo")) & (F.col(idx) < F.col("_lo") + F.col("_size")))
    key = [*group, "_size", "_lo"]
    scale = d0(F.col(length))
    p = cut(p.withColumn("_scale", scale).withColumn("_cut", F.least(F.greatest(scale, F.lit(4.5)), F.lit(8.0))).withColumn("_done", F.lit(False)))
    best = None
    for _ in range(ROUNDS):
        fit = kabsch(p.filter("sel"), key).select(*key, "r", "t", "rmsd")
        q = cut(p.join(fit, key).withColumn("_d", pair_distance(F.col("r"), F.col("t"))))
        third = q.groupBy(*key).agg(F.count_if(F.col("_d") < F.col("_cut")).alias("_in"))
        terms = q.groupBy(*key, "_n").agg(
            (F.sum(F.floor(tm_term(F.col("_d"), F.col("_scale")) * 1048576.0 + 0.5) / 1048576.0) / F.first(length)).alias("tm"),
            F.first("r").alias("r"), F.first("t").alias("t"),
        )
        best = terms if best is None else best.unionByName(terms)
        best = cut(best)
        near = q.join(third, key).withColumn("_near", F.when(F.col("_in") >= 3, F.col("_d") < F.col("_cut")).otherwise(F.col("sel")))
        stop = near.groupBy(*key).agg((F.count_if(F.col("_near") != F.col("sel")) == 0).alias("_stop"))
        p = cut(near.join(stop, key).filter("not _stop").withColumn("sel", F.col("_near")).select(*p.columns))
        if p.isEmpty():
            break
    order = F.struct((-F.col("tm")).alias("k"), (-F.col("_size")).alias("s"), F.col("_lo").alias("l"))
    top = best.groupBy(*group).agg(F.min_by(F.struct("tm", "r", "t"), order).alias("b"))
    return top.select(*group, F.col("b.tm").alias("tm"), F.col("b.r").alias("r"), F.col("b.t").alias("t"))


def domain_turns(pairs: DataFrame, fits: DataFrame, group: list[str], domain: str) -> DataFrame:
    """Degrees each domain still turns after its group's core fit, and its angle against the group's first domain."""
    moved = pairs.join(fits.select(*group, "r", "t"), group)
    at = matrix_apply(F.col("r"), vec_cols()).plus(vec("t"))
    after = moved.select(*group, domain, at.x.alias("x"), at.y.alias("y"), at.z.alias("z"), "u", "v", "w")
    key = [*group, domain]
    turn = kabsch(after, key).select(*key, "n", snap(rotation_angle(F.col("r"))).alias("turn"))
    own = kabsch(pairs, key).select(*key, F.col("r").alias("r_own"))
    first = own.groupBy(*group).agg(F.min_by("r_own", domain).alias("r_first"))
    rel = own.join(first, group)
    a, b = F.col("r_own"), F.col("r_first")
    prod = F.array(*[sum((a[3 * i + k] * b[3 * j + k] for k in range(1, 3)), a[3 * i] * b[3 * j]) for i in range(3) for j in range(3)])
    rel = rel.select(*key, snap(rotation_angle(prod)).alias("against_first"))
    return turn.join(rel, key)


def planar_deviation(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Median, 90th percentile and largest distance between x, y and u, v after the best rigid motion of the plane."""
    c = F.col
    m = pairs.groupBy(*group).agg(*[F.avg(k).alias("m" + k) for k in "xyuv"])
    p = pairs.join(m, group)
    ax, ay, bx, by = c("x") - c("mx"), c("y") - c("my"), c("u") - c("mu"), c("v") - c("mv")
    p = p.select(*group, ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    th = p.groupBy(*group).agg(
        F.atan2(F.sum(c("ax") * c("by") - c("ay") * c("bx")), F.sum(c("ax") * c("bx") + c("ay") * c("by"))).alias("th")
    )
    q = p.join(th, group)
    dx = F.cos("th") * c("ax") - F.sin("th") * c("ay") - c("bx")
    dy = F.sin("th") * c("ax") + F.cos("th") * c("ay") - c("by")
    q = q.select(*group, snap(F.sqrt(dx * dx + dy * dy)).alias("dev"))
    out = quantiles(q, group, "dev", {"median": 0.5, "p90": 0.9, "largest": 1.0})
    return out.select(*group, "n", snap(c("median"), 1e6).alias("median"), snap(c("p90"), 1e6).alias("p90"), "largest")


def relation_share(places: DataFrame, group: list[str]) -> DataFrame:
    """Per group, the mate pairs and those whose left-right and up-down signs agree in both maps.

    A group is one small frame of mates (an element, a domain); its pairs are counted, never kept."""
    side = lambda t: places.select(*group, *[F.col(k).alias(k + t) for k in ("idx", "x", "y", "u", "v")])
    j = side("_a").join(side("_b"), group).filter("idx_a < idx_b")
    sg = lambda k: F.signum(F.col(k + "_a") - F.col(k + "_b"))
    same = (sg("x") == sg("u")) & (sg("y") == sg("v"))
    return j.groupBy(*group).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(same).alias("same"))
