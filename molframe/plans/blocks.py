"""Distance joins whose pairs mostly do not matter, worked out block by block.

Space is cut in blocks of twice the reach. A point goes to its own block, and to those that follow it only where it lies within reach of their
box, so a few slim rows are sent for each point. Points of a block that meet are compared in one call: what comes out are counts
for two units, or the pairs that a coarse test lets through, and no other pair is ever a row. Where more than `crowd` points come to a block, they
are cut in parts on either side, and every two parts meet in a call of their own. Nothing is dropped.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from molframe.plans.tiles import halved
from molframe.session import cut

#: side of a block in reaches, points that one call takes on either side, what rounding may add to a snapped distance
SIDE, CROWD, SLACK = 2.0, 65536, 0.002
XYZ = ("x", "y", "z")
CELLS = ["_cx", "_cy", "_cz"]


def _dealt(points: DataFrame, r: float, group: list[str], idx: str, crowd: int) -> tuple[DataFrame, list[str]]:
    """Rows of a call, and the columns that name the call. `_stay`: the points of the block itself; the others are those that come to it,
    its own ones (`_own`) among them. Two points meet in one call, once if one comes from another block, else once either way round."""
    side, far = SIDE * r, r + SLACK
    p = points.filter(" and ".join(f"{c} is not null" for c in XYZ))
    at = p.select(*p.columns, *[F.floor(F.col(c) / F.lit(side)).cast("bigint").alias(k) for c, k in zip(XYZ, CELLS)])
    near = {-1: lambda c, k: F.col(c) - F.col(k) * side <= far, 0: lambda c, k: F.lit(True), 1: lambda c, k: (F.col(k) + 1) * side - F.col(c) <= far}
    steps = [s for s in itertools.product((-1, 0, 1), repeat=3) if s >= (0, 0, 0)]
    goes = lambda s: near[s[0]](XYZ[0], CELLS[0]) & near[s[1]](XYZ[1], CELLS[1]) & near[s[2]](XYZ[2], CELLS[2])
    to = F.array(*[F.when(goes(s), F.struct(*[F.lit(v).alias(k) for k, v in zip(CELLS, s)])) for s in steps])
    comes = at.withColumn("_o", F.explode(F.array_compact(to)))
    own = (F.col("_o._cx") == 0) & (F.col("_o._cy") == 0) & (F.col("_o._cz") == 0)
    comes = comes.select(*p.columns, *[(F.col(k) + F.col(f"_o.{k}")).alias(k) for k in CELLS], own.alias("_own"))
    full = cut(comes.groupBy(*group, *CELLS).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowd).select(*group, *CELLS, F.ceil(F.col("_n") / crowd).cast("int").alias("_k")))
    mine, every = F.pmod(F.xxhash64(idx), F.col("_k")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    cuts = lambda d: d.withColumn("_k", F.lit(1)) if full.isEmpty() else d.join(full, [*group, *CELLS], "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    comes = cuts(comes).withColumn("_stay", F.lit(False)).withColumn("_i", mine).withColumn("_j", every)
    stays = cuts(at.withColumn("_own", F.lit(True))).withColumn("_stay", F.lit(True)).withColumn("_j", mine).withColumn("_i", every)
    key = [*group, *CELLS, "_i", "_j"]
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # small in bytes, not in work: a given number of partitions is not put together
    return comes.unionByName(stays).drop("_k").repartition(n, *key), key


def blocks_meeting(a: DataFrame, b: DataFrame, r: float, group: list[str] = ("entry",), idx: str = "idx", crowd: int = 16384) -> DataFrame:
    """group, a, b: the points of `a` in a block, with those of `b` that may lie within `r` of one of them, as lists of structs of all their other columns.

    Only `b` is sent to other blocks. Where more than `crowd` of either side come to a block, they are cut in parts, and every two parts are a
    row: each point of `a` meets each of `b` that it may reach once."""
    side, group = SIDE * r, list(group)
    here = lambda d: d.filter(" and ".join(f"{c} is not null" for c in XYZ)).select(*d.columns, *[F.floor(F.col(c) / F.lit(side)).cast("bigint").alias(k) for c, k in zip(XYZ, CELLS)])
    span = lambda c: F.sequence(F.floor((F.col(c) - (r + SLACK)) / F.lit(side)).cast("bigint"), F.floor((F.col(c) + (r + SLACK)) / F.lit(side)).cast("bigint"))
    sent = b.filter(" and ".join(f"{c} is not null" for c in XYZ))
    for c, k in zip(XYZ, CELLS):
        sent = sent.withColumn(k, F.explode(span(c)))
    key = [*group, *CELLS]
    full = lambda d, k: cut(d.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias(k)).filter(F.col(k) > 1))
    stays, comes = here(a), sent
    parts = full(stays, "_n").join(full(comes, "_m"), key, "full").select(*key, *[F.coalesce(k, F.lit(1)).alias(k) for k in ("_n", "_m")])
    parts = cut(parts)
    one = [F.coalesce(k, F.lit(1)).alias(k) for k in ("_n", "_m")]
    cuts = lambda d: d.select("*", F.lit(1).alias("_n"), F.lit(1).alias("_m")) if parts.isEmpty() else d.join(parts, key, "left").select(*d.columns, *one)
    mine, every = lambda k: F.pmod(F.xxhash64(idx), F.col(k)).cast("int"), lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    number = (F.col("_i") * F.col("_m") + F.col("_j")).alias("_part")
    stays = cuts(stays).withColumn("_i", mine("_n")).withColumn("_j", every("_m")).select("*", number)
    comes = cuts(comes).withColumn("_j", mine("_m")).withColumn("_i", every("_n")).select("*", number)
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = lambda d, of, name: d.repartition(n, *key, "_part").groupBy(*key, "_part").agg(F.collect_list(F.struct(*[c for c in of.columns if c not in group])).alias(name))
    return lists(stays, a, "a").join(lists(comes, b, "b").hint("merge"), [*key, "_part"]).select(*group, "a", "b")


def _leaves(xyz: np.ndarray, sort: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Rows, lower and upper corner and sort of small sets of near points, each of one sort."""
    order = np.argsort(sort, kind="stable")
    out = []
    for rows in np.split(order, np.flatnonzero(np.diff(sort[order])) + 1) if len(order) else []:
        for leaf in halved(xyz[rows]):
            at = rows[leaf]
            out.append((at, xyz[at].min(axis=0), xyz[at].max(axis=0), int(sort[at[0]])))
    return out


def _meetings(a: list, b: list, far: float, may: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[tuple, tuple, bool]]:
    """Leaves of either side that may have near points, and whether all their points are sure to be within `far` less twice the slack."""
    if not a or not b:
        return
    low, high, sort = np.array([x[1] for x in b]), np.array([x[2] for x in b]), np.array([x[3] for x in b])
    for leaf in a:
        gap = np.maximum(0.0, np.maximum(low - leaf[2], leaf[1] - high))
        wide = np.maximum(high - leaf[1], leaf[2] - low)
        near = ((gap * gap).sum(axis=1) <= far * far) & may(leaf[3], sort)
        inside = (wide * wide).sum(axis=1) <= max(0.0, far - 2 * SLACK) ** 2
        for k in np.flatnonzero(near):
            yield leaf, b[k], bool(inside[k])


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = np.zeros((len(a), len(b)))
    for d in range(3):
        one = a[:, d][:, None] - b[:, d][None, :]
        one *= one
        sq += one
    return sq


def _sides(t: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Points that come, points that stay, places of both, and which that come are the block's own."""
    stay = t["_stay"].combine_chunks()
    a, b = t.filter(pc.invert(stay)), t.filter(stay)
    xyz = lambda d: np.stack([d[c].to_numpy() for c in XYZ], axis=1).reshape(-1, 3)
    return a, b, xyz(a), xyz(b), a["_own"].to_numpy(zero_copy_only=False).astype(bool)


#: which near pairs count, from a function that gives the values of a column on either side of them, and their snapped distances
Test = Callable[[Callable[[str], tuple[np.ndarray, np.ndarray]], np.ndarray], np.ndarray]


def near_pair_counts(points: DataFrame, r: float, unit: str, group: list[str] = ("entry",), idx: str = "idx", crowd: int = CROWD, test: Test | None = None,
                     numbers: list[str] = ()) -> DataFrame:
    """group, <unit>_a, <unit>_b (the lesser name first), pairs: the pairs of points at a snapped distance of at most `r` of every two
    different units of a group that have any.

    With `test` only pairs for which it holds count. It is given a function of a column (one of `numbers`) that has its values on either side of
    pairs of different units, in no order, and the snapped distances."""
    group, far = list(group), r + SLACK
    rows, key = _dealt(points.filter(F.col(unit).isNotNull()).select(*group, unit, idx, *XYZ, *[c for c in numbers if c not in XYZ]), r, group, idx, crowd)
    kind = {f.name: f.dataType for f in points.schema}
    shape = StructType([*[StructField(g, kind[g]) for g in group], StructField(unit + "_a", kind[unit]), StructField(unit + "_b", kind[unit]), StructField("n", LongType())])

    def counted(t: pa.Table) -> pa.Table:
        a, b, pa_, pb, own = _sides(t)
        names = pc.unique(t[unit])
        names = names.take(pc.sort_indices(names))
        code = lambda d: pc.index_in(d[unit], names).to_numpy(zero_copy_only=False).astype(np.int64)
        k = len(names)
        n = np.zeros((k, k), np.int64)
        if test:
            return answer(tested(a, b, pa_, pb, own, code(a), code(b), n), t, names)
        right = _leaves(pb, code(b))
        # own points come both ways round, and count where the one that comes has the lesser name
        for mine, may in ((own, lambda u, v: u < v), (~own, lambda u, v: u != v)):
            of = np.flatnonzero(mine)
            for (i, *_, u), (j, *_, v), inside in _meetings(_leaves(pa_[of], code(a)[of]), right, far, may):
                if inside:
                    hits = len(i) * len(j)
                else:
                    sq = _squares(pa_[of[i]], pb[j])
                    sure = sq < max(0.0, r - SLACK) ** 2
                    edge = sq[~sure & (sq <= far * far)]
                    hits = np.count_nonzero(sure) + np.count_nonzero(np.floor(np.sqrt(edge) * 1000.0 + 0.5) / 1000.0 <= r)
                n[min(u, v), max(u, v)] += hits
        return answer(n, t, names)

    def tested(a: pa.Table, b: pa.Table, pa_: np.ndarray, pb: np.ndarray, own: np.ndarray, ua: np.ndarray, ub: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = {c: (a[c].to_numpy(), b[c].to_numpy()) for c in {*numbers, idx}}
        plain = lambda p: _leaves(p, np.zeros(len(p), np.int64))
        for (i, *_, _), (j, *_, _), _ in _meetings(plain(pa_), plain(pb), far, lambda u, v: v == u):
            sq = _squares(pa_[i], pb[j])
            u, v = np.nonzero(sq <= far * far)
            apart = np.floor(np.sqrt(sq[u, v]) * 1000.0 + 0.5) / 1000.0
            u, v = i[u], j[v]
            first, second = at[idx][0][u], at[idx][1][v]
            ok = (apart <= r) & (ua[u] != ub[v]) & np.where(own[u], first < second, first != second)
            u, v, apart = u[ok], v[ok], apart[ok]
            ok = test(lambda c, u=u, v=v: (at[c][0][u], at[c][1][v]), apart)
            x, y = ua[u[ok]], ub[v[ok]]
            np.add.at(n, (np.minimum(x, y), np.maximum(x, y)), 1)
        return n

    def answer(n: np.ndarray, t: pa.Table, names: pa.Array) -> pa.Table:
        u, v = np.nonzero(n)
        first = {g: pa.array([t[g][0].as_py()] * len(u), t.schema.field(g).type) for g in group}
        return pa.table(first | {unit + "_a": names.take(pa.array(u)), unit + "_b": names.take(pa.array(v)), "n": pa.array(n[u, v])})

    return rows.groupBy(*key).applyInArrow(counted, shape).groupBy(*group, unit + "_a", unit + "_b").agg(F.sum("n").alias("pairs"))


def near_labels(points: DataFrame, r: float, label: str, group: list[str] = ("entry",), idx: str = "idx", crowd: int = CROWD) -> DataFrame:
    """group, <label>, idx, other: every point with each other label of its group that has a point at a snapped distance of at most `r`, once.

    Two sets of points that are known to be near each other's label are not compared again."""
    group, far = list(group), r + SLACK
    rows, key = _dealt(points.filter(F.col(label).isNotNull()).select(*group, label, idx, *XYZ), r, group, idx, crowd)
    kind = {f.name: f.dataType for f in points.schema}
    shape = StructType([*[StructField(g, kind[g]) for g in group], StructField(label, kind[label]), StructField(idx, kind[idx]), StructField("other", kind[label])])

    def near(t: pa.Table) -> pa.Table:
        a, b, pa_, pb, _ = _sides(t)
        names = pc.unique(t[label])
        code = lambda d: pc.index_in(d[label], names).to_numpy(zero_copy_only=False).astype(np.int64)
        ta, tb = np.zeros((a.num_rows, len(names)), bool), np.zeros((b.num_rows, len(names)), bool)
        for (i, *_, u), (j, *_, v), inside in _meetings(_leaves(pa_, code(a)), _leaves(pb, code(b)), far, lambda u, v: u != v):
            if ta[i, v].all() and tb[j, u].all():
                continue
            if inside:
                ta[i, v] = tb[j, u] = True
                continue
            sq = _squares(pa_[i], pb[j])
            ok = sq < max(0.0, r - SLACK) ** 2
            x, y = np.nonzero(~ok & (sq <= far * far))
            ok[x, y] = np.floor(np.sqrt(sq[x, y]) * 1000.0 + 0.5) / 1000.0 <= r
            ta[i, v] |= ok.any(axis=1)
            tb[j, u] |= ok.any(axis=0)
        (i, u), (j, v) = np.nonzero(ta), np.nonzero(tb)
        first = {g: pa.array([t[g][0].as_py()] * (len(i) + len(j)), t.schema.field(g).type) for g in group}
        both = pa.concat_tables([a.select([label, idx]).take(pa.array(i)), b.select([label, idx]).take(pa.array(j))])
        return pa.table(first | {label: both[label], idx: both[idx], "other": names.take(pa.array(np.concatenate([u, v])))})

    return rows.groupBy(*key).applyInArrow(near, shape).distinct()


#: which near pairs may hold, from a function that gives the values of a column on either side of them
Coarse = Callable[[Callable[[str], tuple[np.ndarray, np.ndarray]]], np.ndarray]


def near_pairs_that(points: DataFrame, r: float, may: Coarse, numbers: list[str], apart: str | None = None, group: list[str] = ("entry",), idx: str = "idx",
                    crowd: int = CROWD) -> DataFrame:
    """Each unordered pair of a group at a snapped distance of at most `r` that the coarse test `may` lets through, once, lower `idx` as _a:
    the rows of `pairs_within` without its `distance` and without most that a later filter would drop.

    `may` is given a function of a column (one of `numbers`) that has its values on either side of near pairs, in no order, and must hold for
    every pair that is wanted. Two points where the boolean column `apart` is true never make a pair."""
    group, far = list(group), r + SLACK
    rows, key = _dealt(points, r, group, idx, crowd)
    rest = [c for c in points.columns if c not in group]
    kind = {f.name: f.dataType for f in points.schema}
    shape = StructType([*[StructField(g, kind[g]) for g in group], *[StructField(c + t, kind[c]) for t in ("_a", "_b") for c in rest]])

    def paired(t: pa.Table) -> pa.Table:
        a, b, pa_, pb, own = _sides(t)
        flag = lambda d: d[apart].to_numpy(zero_copy_only=False).astype(np.int64) if apart else np.zeros(d.num_rows, np.int64)
        at = {c: (a[c].to_numpy(), b[c].to_numpy()) for c in {*numbers, idx}}
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for (i, *_, _), (j, *_, _), _ in _meetings(_leaves(pa_, flag(a)), _leaves(pb, flag(b)), far, lambda u, v: (u == 0) | (v == 0)):
            u, v = np.nonzero(_squares(pa_[i], pb[j]) <= far * far)
            u, v = i[u], j[v]
            first, second = at[idx][0][u], at[idx][1][v]
            ok = np.where(own[u], first < second, first != second)
            u, v = u[ok], v[ok]
            ok = may(lambda c, u=u, v=v: (at[c][0][u], at[c][1][v]))
            left.append(u[ok])
            right.append(v[ok])
        u, v = np.concatenate(left), np.concatenate(right)
        turn = at[idx][0][u] > at[idx][1][v]
        both = pa.concat_tables([a.select([*group, *rest]), b.select([*group, *rest])])
        one, two = np.where(turn, a.num_rows + v, u), np.where(turn, u, a.num_rows + v)
        x, y = both.take(pa.array(one)), both.take(pa.array(two))
        return pa.table({g: x[g] for g in group} | {c + "_a": x[c] for c in rest} | {c + "_b": y[c] for c in rest})

    return rows.groupBy(*key).applyInArrow(paired, shape)
