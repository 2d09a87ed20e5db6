"""Axes of nucleic-acid stems: at every base pair, of the straight pieces a stem is cut into, and the bend between them.

A stem's pairs are rows in the order of its first arm. Sums over a window of pairs are differences of running sums of whole
thousandths, so they are exact whatever the row order; the small eigen problems run in batches. The cut that restarts at
each break is a fold over arrays of at most BLOCK pairs of one stem, carried from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.functions.geom import Vec, snap, vec, vec_angle
from molframe.functions.linalg import eig3
from molframe.functions.text import letters
from molframe.plans.ordered import Ordered, block_of
from molframe.session import cut

WINDOW = 11  # pairs of about one helical turn
LEAST = 5  # pairs of the shortest piece
TURN = 25.0  # degrees of turn at which a new piece begins
BLOCK = 4096
PRODUCTS = ("xx", "xy", "xz", "yy", "yz", "zz")


def thousandths(c: Column) -> Column:
    return F.round(c * 1000.0).cast("bigint")


def _products(d: dict[str, Column], name: str) -> dict[str, Column]:
    return {name + p: d[p[0]] * d[p[1]] for p in PRODUCTS}


def _direction(values: Column, largest: bool, along: Vec) -> Column:
    """The eigenvector of the largest or smallest value, pointing along `along`."""
    v = values["vectors"]
    k = 6 if largest else 0
    axis = Vec(v[k], v[k + 1], v[k + 2])
    return F.when(axis.dot(along) < 0, axis.times(-1.0).struct()).otherwise(axis.struct())


def stem_places(pairs: DataFrame, group: list[str]) -> DataFrame:
    """`pairs` (group, stem, i, j, a, b: the C1' of either nucleotide) with k, the place of the pair in its stem from 0, n, the
    pairs of the stem, `mid`, the middle of the pair, and `plain`: the step from the pair before skips no nucleotide."""
    key = [*group, "stem"]
    mid = vec("a").plus(vec("b")).times(0.5)
    d = pairs.select(*key, "i", "j", "a", "b", mid.struct().alias("mid"))
    o = Ordered(d, key, ["i"], block_of(F.col("i"))).neighbour(["i", "j"], "prev_").row_number("k").done()
    n = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    plain = F.coalesce((F.col("i") == F.col("prev_i") + 1) & (F.col("j") == F.col("prev_j") - 1), F.lit(False))
    return o.join(n, key).withColumn("k", F.col("k") - 1).withColumn("plain", plain).drop("prev_i", "prev_j")


def local_axes(places: DataFrame, group: list[str]) -> DataFrame:
    """`places` (of `stem_places`) with `axis`: at every pair the unit direction most nearly perpendicular to the C1'-C1' lines of
    the pairs around it, about a turn of them and moved inward at the ends, pointing the way the first arm runs."""
    key = [*group, "stem"]
    across = {c: thousandths(F.col("b")[c] - F.col("a")[c]) for c in "xyz"}
    sums = _products(across, "s")
    o = cut(Ordered(places, key, ["k"], block_of(F.col("k"))).running_sums(sums).done())
    width = F.least(F.col("n"), F.lit(WINDOW), F.greatest(F.lit(LEAST), F.floor(F.col("n") / 2)))
    lo = F.least(F.greatest(F.lit(0), F.col("k") - F.floor(width / 2)), F.col("n") - width).cast("bigint")
    w = o.select(*key, "i", "j", "a", "b", "k", "n", "mid", "plain", lo.alias("_lo"), (lo + width - 1).cast("bigint").alias("_hi"))
    # the sum over a window: up to its last pair, less what lies before its first
    first = o.select(*key, F.col("k").alias("_lo"), F.col("mid").alias("_m0"), *[(F.col(c) - v).alias("_b" + c) for c, v in sums.items()])
    last = o.select(*key, F.col("k").alias("_hi"), F.col("mid").alias("_m1"), *[F.col(c).alias("_t" + c) for c in sums])
    j = w.join(first, [*key, "_lo"]).join(last, [*key, "_hi"])
    m = F.array(*[(F.col("_t" + c) - F.col("_b" + c)).cast("double") for c in sums])
    j = j.withColumn("_e", eig3(m))
    return j.select(*key, "i", "j", "a", "b", "k", "n", "mid", "plain", _direction(F.col("_e"), False, vec("_m1").minus(vec("_m0"))).alias("axis"))


def turn_cuts(axes: DataFrame, group: list[str], most: float = TURN, block: int = BLOCK) -> DataFrame:
    """(group, stem, cut): the pairs at which a new piece begins. Going along a stem, a piece ends where the axis has turned more
    than `most` degrees from the one at its start, after LEAST pairs at least and at a plain step only. Each step of the fold
    knows the start of the piece it is in, so blocks of a long stem follow one another; a stem of `block` pairs needs one."""
    key = [*group, "stem"]
    rows = axes.filter(F.col("n") >= 2 * LEAST)
    at = F.struct("k", "plain", F.col("axis.x").alias("x"), F.col("axis.y").alias("y"), F.col("axis.z").alias("z"))
    rows = rows.groupBy(*key, block_of(F.col("k"), block).alias("_blk")).agg(F.array_sort(F.collect_list(at)).alias("_rows"))
    rows = cut(rows)
    last = rows.agg(F.max("_blk")).first()[0]
    kind = "struct<k:bigint,x:double,y:double,z:double,cuts:array<bigint>>"

    def step(piece: Column, row: Column) -> Column:
        turned = snap(vec_angle(vec(piece), vec(row)))
        new = row["plain"] & (turned > most) & (row["k"] - piece["k"] >= LEAST)
        begun = F.struct(row["k"].alias("k"), row["x"].alias("x"), row["y"].alias("y"), row["z"].alias("z"), F.array_append(piece["cuts"], row["k"]).alias("cuts"))
        return F.when(F.coalesce(new, F.lit(False)), begun.cast(kind)).otherwise(piece)

    out, state = None, None
    for b in range(-1 if last is None else last + 1):
        now = rows.filter(F.col("_blk") == b)
        head = F.struct(*[F.col("_rows")[0][c].alias(c) for c in ("k", "x", "y", "z")], F.array().cast("array<bigint>").alias("cuts")).cast(kind)
        now = now.withColumn("_from", head) if b == 0 else now.join(state, key)
        done = cut(now.select(*key, F.aggregate("_rows", F.col("_from"), step).alias("_to")))
        state = done.select(*key, F.struct(*[F.col("_to")[c].alias(c) for c in ("k", "x", "y", "z")], F.array().cast("array<bigint>").alias("cuts")).cast(kind).alias("_from"))
        found = done.select(*key, F.explode(F.col("_to.cuts")).alias("cut"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else axes.select(*key, F.col("k").alias("cut")).limit(0)


def stem_pieces(pairs: DataFrame, backbone: DataFrame, group: list[str], most: float = TURN) -> DataFrame:
    """The straight pieces of every stem: group, stem, piece (from 0), lo, hi (places of its first and last pair), pairs, centre (of
    its C1'), axis (along the first arm) and the first and last i and j.

    pairs: group, stem, i, j, a, b; backbone: group, pos, p (the phosphate, or what stands for it). A stem of fewer than ten pairs stays
    whole, and a last piece of fewer than five joins the one before. A piece of a helical turn or more has the principal axis of its
    backbone points, bulges included; a shorter one the direction across its C1'-C1' lines. A stem of one pair has no axis."""
    key = [*group, "stem"]
    places = cut(local_axes(stem_places(pairs, group), group))
    cuts = turn_cuts(places, group, most).groupBy(*key).agg(F.array_sort(F.collect_list("cut")).alias("_c"))
    n = places.filter("k = 0").select(*key, "n").join(cuts, key, "left")
    c = F.coalesce("_c", F.array().cast("array<bigint>"))
    short = (F.size(c) > 0) & (F.col("n") - F.element_at(c, -1) < LEAST)
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.when(short, F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c))
    n = n.withColumn("_c", begins).select(*key, "n", "_c", F.posexplode("_c").alias("piece", "lo"))
    n = cut(n.select(*key, "piece", "lo", (F.coalesce(F.get("_c", F.col("piece") + 1), F.col("n")) - 1).alias("hi")))
    p = places.join(n.select(*key, "piece", F.explode(F.sequence("lo", "hi")).alias("k")), [*key, "k"])
    across = {c: thousandths(F.col("b")[c] - F.col("a")[c]) for c in "xyz"}
    both = [F.sum(thousandths(F.col("a")[c]) + thousandths(F.col("b")[c])).alias("_c" + c) for c in "xyz"]
    g = p.groupBy(*key, "piece").agg(
        F.count(F.lit(1)).alias("pairs"), *both, *[F.sum(v).alias("_s" + k) for k, v in _products(across, "").items()],
        F.min_by(F.struct("i", "j", "mid"), "k").alias("_first"), F.max_by(F.struct("i", "j", "mid"), "k").alias("_last"),
    )
    g = cut(g.withColumns({"_z" + c: F.round(F.col("_c" + c) / (F.col("pairs") * 2)).cast("bigint") for c in "xyz"}))
    # backbone points of the arms of long pieces, from the piece's centre, so that squares stay small
    arm = lambda lo, hi: g.filter(F.col("pairs") >= WINDOW).select(*key, "piece", "_zx", "_zy", "_zz", F.explode(F.sequence(F.col(lo), F.col(hi))).alias("pos"))
    points = arm("_first.i", "_last.i").unionByName(arm("_last.j", "_first.j")).join(backbone.select(*group, "pos", "p"), [*group, "pos"]).filter("p is not null")
    off = {c: thousandths(F.col("p")[c]) - F.col("_z" + c) for c in "xyz"}
    s = points.groupBy(*key, "piece").agg(
        F.count(F.lit(1)).alias("_m"), *[F.sum(v).alias("_p" + k) for k, v in off.items()], *[F.sum(v).alias("_q" + k) for k, v in _products(off, "").items()]
    )
    j = g.join(s, [*key, "piece"], "left")
    long = F.col("_m").isNotNull()
    spread = F.array(*[(F.col("_q" + p) - F.col("_p" + p[0]) * F.col("_p" + p[1]) / F.col("_m")).cast("double") for p in PRODUCTS])
    flat = F.array(*[F.col("_s" + p).cast("double") for p in PRODUCTS])
    j = j.withColumn("_long", long).withColumn("_e", eig3(F.when(long, spread).otherwise(flat)))
    run = vec("_last.mid").minus(vec("_first.mid"))
    axis = F.when(F.col("_long"), _direction(F.col("_e"), True, run)).otherwise(_direction(F.col("_e"), False, run))
    centre = F.struct(*[(F.col("_c" + c) / (F.col("pairs") * 2) / 1000.0).alias(c) for c in "xyz"])
    out = j.select(
        *key, "piece", "pairs", centre.alias("centre"), F.when(F.col("pairs") > 1, axis).alias("axis"),
        F.col("_first.i").alias("i0"), F.col("_last.i").alias("i1"), F.col("_last.j").alias("j1"), F.col("_first.j").alias("j0"),
    )
    return out.join(n, [*key, "piece"])


def piece_name(name: Column, piece: Column) -> Column:
    """Name of a piece (from 0) of a stem: P2 gives P2a, P2b; P2a gives P2a1, P2a2."""
    small = F.substring(name, -1, 1).rlike("[a-z]")
    return F.concat(name, F.when(small, (piece + 1).cast("string")).otherwise(F.lower(letters(piece))))


def stem_bends(pieces: DataFrame, group: list[str]) -> DataFrame:
    """(group, stem, pieces, straight, bend): degrees between the axes of the first and the last piece, 0 for one piece."""
    g = pieces.groupBy(*group, "stem").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("pairs").alias("pairs"), F.min_by("axis", "piece").alias("_a"), F.max_by("axis", "piece").alias("_b")
    )
    bend = F.when(F.col("pieces") == 1, F.lit(0.0)).otherwise(snap(vec_angle(vec("_a"), vec("_b"))))
    return g.select(*group, "stem", "pieces", "pairs", (F.col("pieces") == 1).alias("straight"), bend.alias("bend"))
