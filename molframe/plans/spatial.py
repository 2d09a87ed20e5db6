"""Distance joins by grid cell, with crowded cells cut into parts.

Points are keyed by the cell of side `r` they lie in. One side is copied to the neighbouring cells, so the join is an
equi-join. A cell that holds more than `crowd` points is split: the copied side goes to every part, the other side
to one part each, so no task meets more than about `crowd` rows of a cell at once. Nothing is dropped.
"""

from __future__ import annotations

import itertools
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.functions.geom import snap
from molframe.plans.rounds import first_by
from molframe.session import cut

REACH = 0.001
CROWD = 2000


def _cells(names: list[str], side: float) -> list[Column]:
    return [F.floor(F.col(n) / F.lit(side)).cast("bigint") for n in names]


def _offsets(dim: int, forward: bool) -> Column:
    steps = [s for s in itertools.product((-1, 0, 1), repeat=dim) if not forward or s >= (0,) * dim]
    return F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(s)]) for s in steps])


def _spread(df: DataFrame, dim: int, cells: list[str], forward: bool) -> DataFrame:
    """Copies of each row, one per neighbouring cell; `forward` takes its own cell (`_own`) and the half of the others that follow it."""
    d = df.withColumn("_o", F.explode(_offsets(dim, forward)))
    if forward:
        d = d.withColumn("_own", reduce(and_, [F.col("_o")[f"o{i}"] == 0 for i in range(dim)]))
    for i, c in enumerate(cells):
        d = d.withColumn(c, F.col(c) + F.col("_o")[f"o{i}"])
    return d.drop("_o")


def _parts(stay: DataFrame, group: list[str], cells: list[str], crowd: int) -> DataFrame:
    """Crowded cells of the side that stays, with the number of parts each is cut into. Counted map-side first."""
    n = stay.groupBy(*group, *cells).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowd)
    return n.select(*group, *cells, F.ceil(F.col("_n") / F.lit(crowd)).cast("int").alias("_parts"))


def grid_join(move: DataFrame, stay: DataFrame, group: list[str], cells: list[str], dim: int, unique: str,
              crowd: int = CROWD, forward: bool = False) -> DataFrame:
    """Equi-join on (group, cell) of copied `move` rows with `stay` rows; the caller filters exactly.

    Neither side may be broadcast: the copies are many times what the plan takes them for, and would be gathered in the driver. Both are
    dealt by the key into a given number of partitions, since the work of a pair of partitions goes with the product of their rows, and
    partitions that are small in bytes would be put together."""
    key = [*group, *cells]
    parts = _parts(stay, group, cells, crowd)
    one = F.coalesce(F.col("_parts"), F.lit(1))
    s = stay.join(parts, key, "left")
    s = s.withColumn("_part", F.pmod(F.xxhash64(F.col(unique)), one).cast("int")).drop("_parts")
    # rows grow by 3 to the `dim` and meet their neighbours where they lie when the other side is small: deal them evenly first
    n = int(move.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    move = move.repartition(n)
    m = _spread(move, dim, cells, forward).join(parts, key, "left")
    m = m.withColumn("_part", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    dealt = lambda d: d.repartition(n, *key, "_part")
    return dealt(m).join(dealt(s).hint("merge"), [*key, "_part"]).drop(*cells, "_part")


def _side(df: DataFrame, group: list[str], xyz: list[str], tag: str, r: float, cells: list[str]) -> DataFrame:
    out = df.select(
        *[F.col(g) for g in group],
        *[F.col(c).alias(c + tag) for c in df.columns if c not in group],
    )
    for name, col in zip(cells, _cells([x + tag for x in xyz], r + REACH)):
        out = out.withColumn(name, col)
    return out


def separation(xyz: list[str], ta: str, tb: str) -> Column:
    sq = [(F.col(n + ta) - F.col(n + tb)) * (F.col(n + ta) - F.col(n + tb)) for n in xyz]
    total = sq[0]
    for s in sq[1:]:
        total = total + s
    return F.sqrt(total)


def worked_out(pairs: DataFrame, **columns: Column) -> DataFrame:
    """`pairs` with further columns that later filters may test without these tests becoming part of the join below: what comes out of
    `inline` is worked out once for each pair, where a plain column would be for every two points of neighbouring cells."""
    return pairs.select(*pairs.columns, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def _near(out: DataFrame, r: float, xyz: list[str]) -> DataFrame:
    """Rows of a grid join at a snapped distance of at most `r`, with `distance`. Only this test belongs to the join."""
    apart = snap(separation(xyz, "_a", "_b"))
    return worked_out(out.filter(apart <= r), distance=apart)


def _also(near: DataFrame, where: Column | None) -> DataFrame:
    return near if where is None else near.filter(F.when(F.col("distance").isNotNull(), where))


def pairs_between(a: DataFrame, b: DataFrame, r: float, group: list[str] = ("entry",), idx: str = "idx",
                  xyz: list[str] = ("x", "y", "z"), where: Column | None = None) -> DataFrame:
    """Rows of `a` and `b` of one group at a snapped distance of at most `r`. Columns get _a and _b; `distance`.

    The side handed in as `a` is the one copied to the neighbouring cells: give the smaller one. `where` may name
    both sides' columns."""
    group, xyz = list(group), list(xyz)
    cells = [f"_c{n}" for n in xyz]
    out = grid_join(_side(a, group, xyz, "_a", r, cells), _side(b, group, xyz, "_b", r, cells), group, cells,
                    len(xyz), idx + "_b")
    near = _near(out, r, xyz)
    return _also(near, where)


def pairs_within(df: DataFrame, r: float, group: list[str] = ("entry",), idx: str = "idx",
                 xyz: list[str] = ("x", "y", "z"), where: Column | None = None) -> DataFrame:
    """Each unordered pair of one group at a snapped distance of at most `r`, once, lower `idx` as _a.

    Points meet those of their own cell and of the half of its neighbours that follow it, so two points meet once."""
    group, xyz = list(group), list(xyz)
    cells = [f"_c{n}" for n in xyz]
    out = grid_join(_side(df, group, xyz, "_a", r, cells), _side(df, group, xyz, "_b", r, cells), group, cells,
                    len(xyz), idx + "_b", forward=True)
    a, b = F.col(idx + "_a"), F.col(idx + "_b")
    near = _near(out.filter(F.when(F.col("_own"), a < b).otherwise(a != b)).drop("_own"), r, xyz)
    rest = [c for c in df.columns if c not in group]
    turned = lambda c, here, there: F.when(a > b, F.col(c + there)).otherwise(F.col(c + here)).alias(c + here)
    near = near.select(*group, *[turned(c, "_a", "_b") for c in rest], *[turned(c, "_b", "_a") for c in rest], "distance")
    return _also(near, where)


def nearest_k(points: DataFrame, r: float, k: int, group: list[str] = ("entry",), idx: str = "idx", xyz: list[str] = ("x", "y", "z")) -> DataFrame:
    """The `k` nearest other points of each point at a snapped distance of at most `r`: group, <idx>_a, <idx>_b, distance, rank. Of equally
    far ones the lower `idx` comes first.

    A point that has k others within a shorter reach needs no longer one, so the reach grows fourfold from round to round, only points still open
    go on, and the pairs of a round stay few. Of points at one place no more than the first k + 1 can be among the nearest of any."""
    group, xyz = list(group), list(xyz)
    at = points.select(*group, idx, *xyz)
    offered = cut(first_by(at, [*group, *xyz], [F.col(idx)], k + 1).drop("rank"))
    # begin where the fullest cell is a matter of one task, or where the grid of distances ends
    steps, reach = [r], r
    full = lambda side: offered.groupBy(*group, *_cells(xyz, side + REACH)).count().agg(F.max("count")).first()[0] or 0
    while reach > 4 * REACH and full(reach) > 16 * k:
        reach = round(reach / 4, 3)
        steps.insert(0, reach)
    open_, found = at, None
    for reach in steps:
        near = pairs_between(open_, offered, reach, group, idx, xyz, F.col(idx + "_a") != F.col(idx + "_b"))
        first = first_by(near.select(*group, idx + "_a", idx + "_b", "distance"), [*group, idx + "_a"], [F.col("distance"), F.col(idx + "_b")], k)
        if reach == steps[-1]:
            return first if found is None else found.unionByName(first)
        first = cut(first)
        done = cut(first.filter(F.col("rank") == k).select(*group, idx + "_a"))
        settled = first.join(done, [*group, idx + "_a"], "left_semi")
        found = settled if found is None else found.unionByName(settled)
        open_ = cut(open_.join(done.withColumnRenamed(idx + "_a", idx), [*group, idx], "left_anti"))
        if open_.isEmpty():
            return found


def boxes_meeting(boxes: DataFrame, side: float, tolerance: float, group: list[str] = ("entry",),
                  idx: str = "idx") -> DataFrame:
    """Pairs of boxes (x0 x1 y0 y1) that overlap by more than `tolerance` both ways. Boxes are keyed by every cell
    they cover; a pair is kept in the one cell that holds the lower corner of the overlap."""
    group = list(group)
    cover = lambda lo, hi: F.explode(
        F.sequence(F.floor(F.col(lo) / side).cast("bigint"), F.floor(F.col(hi) / side).cast("bigint"))
    )
    keyed = boxes.withColumn("_cx", cover("x0", "x1")).withColumn("_cy", cover("y0", "y1"))
    cells = ["_cx", "_cy"]
    tagged = lambda t: keyed.select(
        *group, *cells, *[F.col(c).alias(c + t) for c in boxes.columns if c not in group]
    )
    key = [*group, *cells]
    left, right = tagged("_a"), tagged("_b")
    parts = _parts(right, group, cells, CROWD)
    one = F.coalesce(F.col("_parts"), F.lit(1))
    right = right.join(parts, key, "left").withColumn("_part", F.pmod(F.xxhash64(idx + "_b"), one).cast("int"))
    left = left.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), one - 1)))
    out = left.drop("_parts").join(right.drop("_parts"), [*key, "_part"])
    over = lambda a0, a1, b0, b1: F.least(F.col(a1), F.col(b1)) - F.greatest(F.col(a0), F.col(b0))
    out = out.withColumn("dx", over("x0_a", "x1_a", "x0_b", "x1_b")).withColumn("dy", over("y0_a", "y1_a", "y0_b", "y1_b"))
    home = (F.col("_cx") == F.floor(F.greatest("x0_a", "x0_b") / side)) & (
        F.col("_cy") == F.floor(F.greatest("y0_a", "y0_b") / side)
    )
    meets = (F.col("dx") > tolerance) & (F.col("dy") > tolerance) & (F.col(idx + "_a") < F.col(idx + "_b"))
    return out.filter(home & meets).drop(*cells, "_part")


def segment_crossings(segs: DataFrame, side: float, group: list[str] = ("entry",), idx: str = "idx") -> DataFrame:
    """Proper crossings of segments (px py qx qy) of different polylines (`line`): boxes first, then the signs."""
    boxes = (
        segs.withColumn("x0", F.least("px", "qx")).withColumn("x1", F.greatest("px", "qx"))
        .withColumn("y0", F.least("py", "qy")).withColumn("y1", F.greatest("py", "qy"))
    )
    near = boxes_meeting(boxes, side, -1e-12, group, idx)
    turn = lambda a, b, c: (F.col(b[0]) - F.col(a[0])) * (F.col(c[1]) - F.col(a[1])) - (
        F.col(b[1]) - F.col(a[1])
    ) * (F.col(c[0]) - F.col(a[0]))
    pa, qa, pb, qb = ("px_a", "py_a"), ("qx_a", "qy_a"), ("px_b", "py_b"), ("qx_b", "qy_b")
    cross = (turn(pa, qa, pb) * turn(pa, qa, qb) < 0) & (turn(pb, qb, pa) * turn(pb, qb, qa) < 0)
    return near.filter((F.col("line_a") != F.col("line_b")) & cross)
