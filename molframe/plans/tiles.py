"""Groups of points (residues, elements) that touch, worked out tile by tile.

A join of points by distance makes a row of every near pair, and counting these rows for two residues sends them all once more. Here
whole units are laid in tiles along a space-filling curve, a tile meets each tile whose box is near in one call, and what comes out is one row
for two units: no pair of points is ever a row, and nothing is sent on afterwards. What is sent are the tiles, once for every near tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from molframe.plans.intervals import spans_meeting
from molframe.plans.ordered import Ordered
from molframe.session import cut

#: points of a tile (a unit counts as eight at least), points of a unit that is cut in pieces, points of a block inside a call
TILE, PIECE, BLOCK = 16384, 8192, 256
#: points of a tile, so units at most, where every two units of two tiles are marked in a table
MARKED = 8192


def _curve(cells: list[Column], bits: int = 10) -> Column:
    """Place of a cell on the curve that winds through all cells: the bits of its numbers in turn."""
    at = F.lit(0).cast("bigint")
    for d, c in enumerate(cells):
        for k in range(bits):
            at = at + F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1).cast("bigint")), len(cells) * k + d)
    return at


def _laid(points: DataFrame, group: list[str], unit: list[str], idx: str, r: float, tile: int | None = None, least: int = 8, also: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """Units as rows (group, unit, _cut, _tile, box, lists xs ys zs ks and those of `also`), written once; and whether any had to be cut in pieces."""
    points = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    big = points.groupBy(*group, *unit).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > PIECE)
    any_big = not big.isEmpty()
    p = points.withColumn("_piece", F.lit(0).cast("bigint")).withColumn("_cut", F.lit(False))
    if any_big:
        p = points.join(big.select(*group, *unit, F.ceil(F.col("_n") / PIECE).alias("_k")), [*group, *unit], "left")
        p = p.withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(idx), F.col("_k")), F.lit(0))).withColumn("_cut", F.col("_k").isNotNull()).drop("_k")
    rows = F.collect_list(F.struct("x", "y", "z", "kind_", *also))
    u = p.groupBy(*group, *unit, "_piece", "_cut").agg(rows.alias("_p"), *[f(c).alias(c + t) for c in "xyz" for f, t in ((F.min, "0"), (F.max, "1"))])
    u = u.select(*group, *unit, "_piece", "_cut", *[c + t for c in "xyz" for t in "01"], *[F.col("_p")[c].alias(n) for c, n in (("x", "xs"), ("y", "ys"), ("z", "zs"), ("kind_", "ks"), *[(c, c) for c in also])])
    cell = [F.pmod(F.floor((F.col(c + "0") + F.col(c + "1")) / F.lit(2 * r)).cast("bigint"), F.lit(1024)) for c in "xyz"]
    u = cut(u.withColumn("_w", F.greatest(F.size("xs"), F.lit(least))).withColumn("_at", _curve(cell)))
    cells = u.groupBy(*group, "_at").agg(F.sum("_w").alias("_all"))
    cells = Ordered(cells, group, ["_at"], F.shiftright("_at", 12)).running_sum(F.col("_all"), "_to").done()
    u = u.join(cells, [*group, "_at"])
    within = F.pmod(F.xxhash64(*unit, "_piece"), F.col("_all"))
    u = u.withColumn("_tile", F.floor((F.col("_to") - F.col("_all") + within) / (tile or TILE)).cast("bigint"))
    return cut(u.drop("_at", "_all", "_to", "_w", "_piece")), any_big


def halved(xyz: np.ndarray) -> Iterator[np.ndarray]:
    """Rows cut at the middle of their longest side until none holds more than a block."""
    open_ = [np.arange(len(xyz))]
    while open_:
        rows = open_.pop()
        if len(rows) <= BLOCK:
            yield rows
            continue
        at = xyz[rows]
        side = int(np.argmax(at.max(axis=0) - at.min(axis=0)))
        half = len(rows) // 2
        rows = rows[np.argpartition(at[:, side], half)]
        open_ += [rows[:half], rows[half:]]


def near_counts(a: tuple, b: tuple, size: tuple[int, int], reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every two units the number of near pairs of points and the least snapped distance. A side: xyz, kind and unit of every point."""
    (pa_, ka, ua), (pb, kb, ub) = a, b
    far = float(reach.max()) + 0.002
    n, least = np.zeros(size[0] * size[1], np.int64), np.full(size[0] * size[1], np.inf)
    left, right = [[(r, p[r].min(axis=0), p[r].max(axis=0)) for r in halved(p)] for p in (pa_, pb)]
    if not left or not right:
        return n, least
    low, high = np.array([x[1] for x in right]), np.array([x[2] for x in right])
    beyond = lambda p, lo, hi: (np.square(np.maximum(0.0, np.maximum(lo - p, p - hi)))).sum(axis=1) > far * far
    for block, lo, hi in left:
        gap = np.maximum(0.0, np.maximum(low - hi, lo - high))
        for k in np.flatnonzero((gap * gap).sum(axis=1) <= far * far):
            # of two blocks only the points that are near the other's box
            rows, others = block[~beyond(pa_[block], low[k], high[k])], right[k][0]
            others = others[~beyond(pb[others], lo, hi)]
            sq = np.zeros((len(rows), len(others)))
            for d in range(3):
                one = pa_[rows, d][:, None] - pb[others, d][None, :]
                one *= one
                sq += one
            i, j = np.nonzero(sq <= far * far)
            apart = np.floor(np.sqrt(sq[i, j]) * 1000.0 + 0.5) / 1000.0
            i, j = rows[i], others[j]
            ok = apart <= reach[ka[i], kb[j]]
            key = ua[i[ok]] * size[1] + ub[j[ok]]
            np.add.at(n, key, 1)
            np.minimum.at(least, key, apart[ok])
    return n, least


def near_hits(a: tuple, b: tuple, reach: np.ndarray, one: bool, measured: bool = False) -> Iterator[tuple]:
    """Near pairs of points, those of two small sets at a time: their rows on either side and, if `measured`, the snapped distances. A side: xyz
    and kind of every point. Of one side with itself (`one`) each two points come once."""
    (pa_, ka), (pb, kb) = a, b
    if not len(pa_) or not len(pb):
        return
    far = float(reach.max()) + 0.002
    sure, most = [np.where(reach >= 0, np.square(np.maximum(0.0, reach + d)), -1.0) for d in (-0.002, 0.002)]
    mid = pa_.mean(axis=0)
    ma, mb = pa_ - mid, pb - mid
    qa, qb = [(m * m).sum(axis=1) for m in (ma, mb)]
    left = [(r, pa_[r].min(axis=0), pa_[r].max(axis=0)) for r in halved(pa_)]
    right = left if one else [(r, pb[r].min(axis=0), pb[r].max(axis=0)) for r in halved(pb)]
    low, high = np.array([x[1] for x in right]), np.array([x[2] for x in right])
    beyond = lambda p, lo, hi: (np.square(np.maximum(0.0, np.maximum(lo - p, p - hi)))).sum(axis=1) > far * far
    for n, (block, lo, hi) in enumerate(left):
        gap = np.maximum(0.0, np.maximum(low - hi, lo - high))
        for k in np.flatnonzero((gap * gap).sum(axis=1) <= far * far):
            if one and k < n:
                continue
            # of two blocks only the points that are near the other's box
            rows, others = block[~beyond(pa_[block], low[k], high[k])], right[k][0]
            others = others[~beyond(pb[others], lo, hi)]
            sq = ma[rows] @ (-2.0 * mb[others].T)
            sq += qa[rows][:, None]
            sq += qb[others][None, :]
            at = np.flatnonzero(sq <= far * far)
            i, j = np.divmod(at, max(1, len(others)))
            d, i, j = sq.ravel()[at], rows[i], others[j]
            if one and k == n:
                d, i, j = [v[i < j] for v in (d, i, j)]
            if reach.size == 1:
                edge, ok = d >= sure[0, 0], None
            else:
                ok = d <= most[ka[i], kb[j]]
                edge = ok & (d >= sure[ka[i], kb[j]])
            if measured or edge.any():
                # what the product of the places leaves open is worked out by differences
                e = np.arange(len(i)) if measured else np.flatnonzero(edge)
                x, y = i[e], j[e]
                apart = np.zeros(len(e))
                for c in range(3):
                    apart += np.square(pa_[x, c] - pb[y, c])
                apart = np.floor(np.sqrt(apart) * 1000.0 + 0.5) / 1000.0
                ok = np.ones(len(i), bool) if ok is None else ok
                ok[e] &= apart <= (reach[0, 0] if reach.size == 1 else reach[ka[x], kb[y]])
            if ok is not None:
                i, j = i[ok], j[ok]
            yield (i, j, apart[ok]) if measured else (i, j)


def _points(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, kind and unit of every point of a table of units."""
    flat = lambda c: pa.concat_arrays([x.flatten() for x in t[c].chunks]).to_numpy(zero_copy_only=False)
    size = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in t["xs"].chunks])
    return np.stack([flat("xs"), flat("ys"), flat("zs")], axis=1), flat("ks"), np.repeat(np.arange(t.num_rows), size)


class Tally:
    """Counts of whole numbers, added up now and then so that what is held stays small."""

    def __init__(self, most: int = 1 << 22):
        self.most, self.held, self.size = most, [], 0

    def add(self, codes: np.ndarray, counts: np.ndarray | None = None) -> None:
        codes, n = np.unique(codes, return_counts=True) if counts is None else (codes, counts)
        self.held.append((codes, n))
        self.size += len(codes)
        if self.size > self.most and len(self.held) > 1:
            self.held, self.size = [self.whole()], 0

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, at = np.unique(np.concatenate([c for c, _ in self.held]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in self.held])).astype(np.int64)


def _counting(reach: np.ndarray, group: list[str], unit: list[str], label: str, named: str | None):
    """The rows of two tiles: units in touch and near pairs of points of every two labels, and the units in touch of which one is cut, one by one."""
    rest = [c for c in unit if c != label]

    def rows(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by(label), b.sort_by(label)
        one = bool(a.num_rows and b.num_rows) and a["_ta"][0] == a["_tb"][0]
        b = a if one else b
        names = pc.unique(pa.chunked_array(a[label].chunks + b[label].chunks, a.schema.field(label).type))
        names = names.take(pc.sort_indices(names))
        la, lb = [pc.index_in(t[label], names).to_numpy().astype(np.int64) for t in (a, b)]
        n = len(names)
        few = n * n <= 65536
        touch, near = np.zeros((a.num_rows, b.num_rows), np.uint8), Tally()
        count = np.zeros(n * n, np.int64)
        left = _points(a) if a.num_rows and b.num_rows else None
        right = left if one or left is None else _points(b)
        for i, j in near_hits(left[:2], right[:2], reach, one) if left else ():
            u, v = left[2][i], right[2][j]
            x, y = la[u], lb[v]
            if one:
                turn = x > y
                u, v = np.where(turn, v, u), np.where(turn, u, v)
            code = np.minimum(x, y) * n + np.maximum(x, y)
            ok = x != y
            touch[u[ok], v[ok]] = 1
            if few:
                count += np.bincount(code[ok], minlength=n * n)
            else:
                near.add(code[ok])
        if few:
            near.add(np.flatnonzero(count), count[np.flatnonzero(count)])
        if named:
            touch[a[named].is_null().to_numpy().astype(bool)] = 0
            touch[:, b[named].is_null().to_numpy().astype(bool)] = 0
        cut_a, cut_b = [t["_cut"].to_numpy().astype(bool) for t in (a, b)]
        u = v = np.zeros(0, np.int64)
        if cut_a.any() or cut_b.any():
            u, v = np.nonzero(touch & (cut_a[:, None] | cut_b[None, :]))
            touch[u, v] = 0
        units = Tally()
        if few and touch.size:
            ends = [np.flatnonzero(np.diff(k, prepend=-1)) for k in (la, lb)]
            sums = np.add.reduceat(np.add.reduceat(touch, ends[0], axis=0, dtype=np.int32), ends[1], axis=1, dtype=np.int64)
            p, q = np.nonzero(sums)
            x, y = la[ends[0]][p], lb[ends[1]][q]
            # the two tiles may hold two labels either way round
            for turned in (x < y, x > y):
                units.add(*_sorted(np.minimum(x, y)[turned] * n + np.maximum(x, y)[turned], sums[p, q][turned]))
        elif touch.size:
            for lo in range(0, len(la), 512):
                p, q = np.nonzero(touch[lo : lo + 512])
                x, y = la[lo + p], lb[q]
                units.add(np.minimum(x, y) * n + np.maximum(x, y))
        code, pairs = near.whole()
        held, k = units.whole()
        of = np.zeros(len(code), np.int64)
        of[np.searchsorted(code, held)] = k
        turn = la[u] > lb[v]
        lo, hi = np.where(turn, lb[v], la[u]), np.where(turn, la[u], lb[v])
        m, c = len(code), len(u)
        # an empty tile has no rows: any of the other's will do for the group
        first = {g: pa.array([(a if a.num_rows else b)[g][0].as_py()] * (m + c), a.schema.field(g).type) for g in group}
        both = pa.concat_tables([a.select(rest), b.select(rest)])
        ends = (np.where(turn, a.num_rows + v, u), np.where(turn, u, a.num_rows + v))
        blank = lambda w: pa.array(np.concatenate([np.zeros(m, np.int64), w]), mask=np.concatenate([np.ones(m, bool), np.zeros(c, bool)]))
        return pa.table(
            first | {label + "_a": names.take(pa.array(np.concatenate([code // max(1, n), lo]))), label + "_b": names.take(pa.array(np.concatenate([code % max(1, n), hi])))}
            | {"units": pa.array(np.concatenate([of, np.zeros(c, np.int64)])), "pairs": pa.array(np.concatenate([pairs, np.zeros(c, np.int64)])), "_cut": pa.array(np.arange(m + c) >= m)}
            | {f"{r}_{t}": both[r].take(blank(w)) for t, w in zip("ab", ends) for r in rest}
        )

    return rows


def _nearest_of(group: list[str], unit: list[str], name: str, reach: np.ndarray, most: int = 1 << 22):
    """The rows of two tiles: every two units in touch, the lesser first, with their nearest points, of equally near ones the first by name."""

    def rows(a: pa.Table, b: pa.Table) -> pa.Table:
        one = bool(a.num_rows and b.num_rows) and a["_ta"][0] == b["_tb"][0]
        b = a if one else b
        held = [*group, *unit, "_cut"]
        both = a.select(held) if one else pa.concat_tables([a.select(held), b.select(held)])
        order = pc.sort_indices(both, sort_keys=[(u, "ascending") for u in unit]).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        flat = lambda t: pa.chunked_array([x.flatten() for x in t[name].chunks], pa.string())
        words = [flat(t) for t in (a, b)]
        names = pc.unique(pa.chunked_array([c for w in words for c in w.chunks], pa.string()))
        names = names.take(pc.sort_indices(names))
        k, m = len(order), max(1, len(names))
        span = (int(round(float(reach.max()) * 1000.0)) + 1) * m * m
        key, tail = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def least() -> None:
            x, y = np.concatenate(key), np.concatenate(tail)
            if k * k * span < 1 << 63:
                x = np.sort(x * span + y)
                x, y = np.divmod(x, span)
            else:
                o = np.lexsort((y, x))
                x, y = x[o], y[o]
            first = np.flatnonzero(np.diff(x, prepend=-1))
            key[:], tail[:] = [x[first]], [y[first]]

        if a.num_rows and b.num_rows:
            code = [pc.index_in(w, names).to_numpy().astype(np.int64) for w in words]
            left = _points(a)
            right = left if one else _points(b)
            ra, rb = rank[: a.num_rows], rank if one else rank[a.num_rows :]
            size = 0
            for i, j, apart in near_hits(left[:2], right[:2], reach, one, measured=True):
                u, v, x, y = ra[left[2][i]], rb[right[2][j]], code[0][i], code[1][j]
                lo, hi = np.minimum(u, v), np.maximum(u, v)
                ok = lo < hi
                first, second = np.where(u < v, x, y), np.where(u < v, y, x)
                key.append((lo * k + hi)[ok])
                tail.append(((np.rint(apart * 1000.0).astype(np.int64) * m + first) * m + second)[ok])
                size += len(i)
                if size > most:
                    least()
                    size = 0
            least()
        x, y = key[0], tail[0]
        one_, two = (both.take(pa.array(order[v])) for v in (x // max(1, k), x % max(1, k)))
        word = lambda v: names.take(pa.array(v))
        return pa.table(
            {g: one_[g] for g in group} | {u + "_a": one_[u] for u in unit} | {u + "_b": two[u] for u in unit}
            | {name + "_a": word(y // m % m), name + "_b": word(y % m), "distance": pa.array(y // (m * m) / 1000.0), "_cut": pc.or_(one_["_cut"], two["_cut"])}
        )

    return rows


def nearest_of_units(points: DataFrame, unit: list[str], name: str, reach: list[list[float]], group: list[str] = ("entry",), idx: str = "idx") -> DataFrame:
    """group, the columns of `unit` and `name` as _a and _b, distance: every two different units that touch, the lesser first, with the names of
    their nearest points; of equally near ones the first by name of the lesser unit's and then of the other's.

    As in `units_touching`; no pair of points is a row, and only the rows of units that are cut in pieces are sent on."""
    group, r = list(group), max(max(x) for x in reach)
    laid, any_cut = _laid(points, group, unit, idx, r, MARKED, also=(name,))
    kind = {f.name: f.dataType for f in points.schema}
    ends = [StructField(f"{c}_{t}", kind[c]) for t in "ab" for c in unit]
    shape = StructType([*[StructField(g, kind[g]) for g in group], *ends, *[StructField(f"{name}_{t}", kind[name]) for t in "ab"], StructField("distance", DoubleType()), StructField("_cut", BooleanType())])
    met = _tiles_meeting(laid, laid, group, unit, unit, r, True, (name,)).applyInArrow(_nearest_of(group, unit, name, np.array(reach, np.float64)), shape)
    if not any_cut:
        return met.drop("_cut")
    met = cut(met)
    key = [*group, *[f.name for f in ends]]
    differ = F.struct(*[F.col(c + "_a").alias(c) for c in unit]) != F.struct(*[F.col(c + "_b").alias(c) for c in unit])
    best = met.filter(F.col("_cut") & differ).groupBy(*key).agg(F.min(F.struct("distance", name + "_a", name + "_b")).alias("_k"))
    return met.filter("not _cut").drop("_cut").unionByName(best.select(*key, f"_k.{name}_a", f"_k.{name}_b", "_k.distance"))


def _sorted(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes)
    return codes[order], counts[order]


def touching_counts(points: DataFrame, unit: list[str], label: str, reach: list[list[float]], named: str | None = None, group: list[str] = ("entry",),
                    idx: str = "idx") -> DataFrame:
    """group, <label>_a, <label>_b (the lesser first), units, pairs: for every two labels of a group with near points, how many of their units touch
    and how many pairs of points are near.

    As in `units_touching`, but what comes out is a row for two labels of two tiles. A unit is named by `unit`, its label among the columns; one
    whose column `named` is null counts for pairs alone."""
    group, r = list(group), max(max(x) for x in reach)
    laid, any_cut = _laid(points.filter(F.col(label).isNotNull()), group, unit, idx, r, MARKED, 1)
    met = _tiles_meeting(laid, laid, group, unit, unit, r, True)
    kind = {f.name: f.dataType for f in laid.schema}
    rest = [c for c in unit if c != label]
    counts = [StructField("units", LongType()), StructField("pairs", LongType()), StructField("_cut", BooleanType())]
    shape = StructType([*[StructField(g, kind[g]) for g in group], *[StructField(f"{label}_{t}", kind[label]) for t in "ab"], *counts, *[StructField(f"{c}_{t}", kind[c]) for t in "ab" for c in rest]])
    met = met.applyInArrow(_counting(np.array(reach, np.float64), group, unit, label, named), shape)
    key = [*group, label + "_a", label + "_b"]
    out = met.select(*key, "units", "pairs")
    if any_cut:
        met = cut(met)
        pieces = met.filter("_cut").select(*key, *[f"{c}_{t}" for t in "ab" for c in rest]).distinct()
        out = met.select(*key, "units", "pairs").unionByName(pieces.select(*key, F.lit(1).cast("bigint").alias("units"), F.lit(0).cast("bigint").alias("pairs")))
    return out.groupBy(*key).agg(F.sum("units").alias("units"), F.sum("pairs").alias("pairs"))


def _meeting(reach: np.ndarray, columns: list[tuple[str, str]], same: bool):
    """The rows of two tiles: every two units in touch. Of one tile with itself each two units come once."""

    def side(t: pa.Table) -> tuple:
        flat = lambda c: pa.concat_arrays([x.flatten() for x in t[c].chunks]).to_numpy(zero_copy_only=False)
        size = np.diff(np.concatenate([[0], np.cumsum([len(v) for c in t["xs"].chunks for v in c])]))
        return np.stack([flat("xs"), flat("ys"), flat("zs")], axis=1), flat("ks"), np.repeat(np.arange(t.num_rows), size)

    def rows(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            i = j = np.zeros(0, np.int64)
            n, least = i, np.zeros(0)
        else:
            one = same and a["_ta"][0] == a["_tb"][0]
            b = a if one else b
            n, least = near_counts(side(a), side(b), (a.num_rows, b.num_rows), reach)
            hit = np.flatnonzero(n)
            i, j = hit // b.num_rows, hit % b.num_rows
            if one:
                hit, i, j = hit[i < j], i[i < j], j[i < j]
            n, least = n[hit], least[hit]
        got = {c + t: d[c].take(pa.array(k)) for d, t, k in ((a, "_a", i), (b, "_b", j)) for c in [x for x, s in columns if s == t]}
        return pa.table(got | {"pairs": pa.array(n), "distance": pa.array(least)})

    return rows


def _tiles_meeting(left: DataFrame, right: DataFrame, group: list[str], unit_a: list[str], unit_b: list[str], r: float, same: bool, also: tuple[str, ...] = ()):
    """Rows of every two tiles whose boxes are within reach, together: a cogroup."""
    box = lambda d, t: d.groupBy(*group, "_tile").agg(*[f(c + e).alias(c + e) for c in "xyz" for f, e in ((F.min, "0"), (F.max, "1"))]).select(
        *group, F.col("_tile").alias("tile"), F.floor(F.col("x0") - r).cast("bigint").alias("lo"), F.ceil(F.col("x1") + r).cast("bigint").alias("hi"), *[c + e for c in "xyz" for e in "01"])
    p = spans_meeting(box(left, "_a"), box(right, "_b"), group, "lo", "hi")
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}0_b") - F.col(f"{c}1_a"), F.col(f"{c}0_a") - F.col(f"{c}1_b"))
    p = p.filter(gap("x") * gap("x") + gap("y") * gap("y") + gap("z") * gap("z") <= F.lit((r + 0.002) ** 2))
    p = cut(p.filter("tile_a <= tile_b" if same else "true").select(*group, F.col("tile_a").alias("_ta"), F.col("tile_b").alias("_tb")))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [*group, "_ta", "_tb"]
    held = ["_cut", "xs", "ys", "zs", "ks", *also]
    # small in bytes, not in work: a given number of partitions is not put together
    dealt = lambda d, t, unit: p.join(d.withColumnRenamed("_tile", t), [*group, t]).select(*[F.col(c).alias(c) for c in [*key, *unit, *held]]).repartition(n, *key)
    return dealt(left, "_ta", unit_a).groupBy(*key).cogroup(dealt(right, "_tb", unit_b).groupBy(*key))


def units_touching(a: DataFrame, b: DataFrame | None, unit_a: list[str], unit_b: list[str], reach: list[list[float]], group: list[str] = ("entry",),
                   idx: str = "idx") -> DataFrame:
    """Every unit of `a` with every unit of `b` of its group that it touches: columns of the units as _a and _b, `pairs` of points in reach and
    the least snapped `distance`. Without `b` every two different units of `a` come once, in no order.

    Points have the group, the unit's columns (its name and what goes with it), idx, x, y, z and `kind_`, a whole number from 0: two points are in
    reach up to `reach[kind of a][kind of b]`, never if that is negative. A unit above 8,192 points is cut in pieces, and only
    the rows of such units are added up afterwards."""
    group, r, same = list(group), max(max(x) for x in reach), b is None
    left, cut_a = _laid(a, group, unit_a, idx, r)
    right, cut_b = (left, cut_a) if same else _laid(b, group, unit_b, idx, r)
    met = _tiles_meeting(left, right, group, unit_a, unit_b, r, same)
    columns = [*[(c, "_a") for c in [*group, *unit_a, "_cut"]], *[(c, "_b") for c in [*unit_b, "_cut"]]]
    kind = {"_a": {f.name: f.dataType for f in left.schema}, "_b": {f.name: f.dataType for f in right.schema}}
    shape = StructType([*[StructField(c + t, kind[t][c]) for c, t in columns], StructField("pairs", LongType()), StructField("distance", DoubleType())])
    met = met.applyInArrow(_meeting(np.array(reach, np.float64), columns, same), shape)
    met = met.select(*[F.col(g + "_a").alias(g) for g in group], *[c + "_a" for c in unit_a], *[c + "_b" for c in unit_b], "pairs", "distance", (F.col("_cut_a") | F.col("_cut_b")).alias("_cut"))
    if not (cut_a or cut_b):
        return met.drop("_cut")
    names = [*group, *[c + "_a" for c in unit_a], *[c + "_b" for c in unit_b]]
    pieces = met.filter("_cut")
    if same:
        one, two = F.struct(*[F.col(c + "_a").alias(c) for c in unit_a]), F.struct(*[F.col(c + "_b").alias(c) for c in unit_a])
        turned = lambda c, t: F.when(one > two, F.col(c + ("_b" if t == "_a" else "_a"))).otherwise(F.col(c + t)).alias(c + t)
        pieces = pieces.filter(one != two).select(*group, *[turned(c, t) for t in ("_a", "_b") for c in unit_a], "pairs", "distance")
    whole = pieces.groupBy(*names).agg(F.sum("pairs").alias("pairs"), F.min("distance").alias("distance"))
    return met.filter("not _cut").drop("_cut").unionByName(whole)
