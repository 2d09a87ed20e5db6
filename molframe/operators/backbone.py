"""From atoms to backbone residues, and from backbone to secondary structure codes and elements.

`atoms`: entry, chain, seq, icode, resname, atom, elem, het, b, idx, x, y, z. `residues`: one row per residue with n,
ca, c, o structs; `k` its place in the entry, `prev` whether it is bonded to the one before. Chain order is always
read from `idx` or `k`; windows are two-level, so a long chain is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.functions.geom import Vec, dist, snap, vec
from molframe.functions.linalg import eig3
from molframe.functions import chemistry as chem
from molframe.plans.blocks import blocks_meeting
from molframe.plans.ordered import Ordered, block_of
from molframe.plans.rounds import first_by
from molframe.session import cut

RES = ["entry", "chain", "seq", "icode"]
BOND = 2.5
CO = 1.231


def _chain(df: DataFrame, place: str = "idx", keys: tuple = ("entry", "chain")) -> Ordered:
    return Ordered(df, list(keys), [place], block_of(F.col(place)))


def one_conformer(atoms: DataFrame) -> DataFrame:
    """Atoms with no altloc, plus one letter per residue: the entry's first letter if the residue has it, else the
    residue's own first."""
    some = atoms.filter("altloc is not null and altloc <> ''")
    entry = some.groupBy("entry").agg(F.min("altloc").alias("_e"))
    res = some.groupBy(*RES).agg(F.min("altloc").alias("_r"), F.collect_set("altloc").alias("_s"))
    pick = res.join(entry, "entry").select(*RES, F.when(F.array_contains("_s", F.col("_e")), F.col("_e")).otherwise(F.col("_r")).alias("_keep"))
    j = atoms.join(pick, RES, "left")
    return j.filter((F.coalesce("altloc", F.lit("")) == "") | (F.col("altloc") == F.col("_keep"))).drop("_keep")


def residue_rows(atoms: DataFrame) -> DataFrame:
    """One row per residue with its backbone atoms, B-factor and carbons; the first residue of a repeated number."""
    at = lambda name: F.min(F.when(F.col("atom") == name, F.struct("idx", "x", "y", "z"))).alias(name.lower())
    g = atoms.groupBy(*RES, "resname").agg(
        *[at(n) for n in ("N", "CA", "C", "O")], F.min("idx").alias("idx"), F.max(F.when(F.col("atom") == "CA", F.col("b"))).alias("b"),
        F.bool_or("het").alias("het"),
        F.collect_list(F.when(F.col("elem") == "C", F.struct("x", "y", "z"))).alias("carbons"),
        F.collect_list(F.when(F.col("elem") == "N", F.struct("x", "y", "z"))).alias("nitrogens"),
    )
    bare = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c + ".x").alias("x"), F.col(c + ".y").alias("y"), F.col(c + ".z").alias("z")))
    first = g.groupBy(*RES).agg(F.min("idx").alias("idx"))
    return g.join(first, [*RES, "idx"], "left_semi").select(
        *RES, "resname", "idx", "b", "het", *[bare(c).alias(c) for c in ("n", "ca", "c", "o")], "carbons", "nitrogens"
    )


def _nearest(points: Column, to: Column) -> Column:
    """The point of an array nearest `to`, with its distance; null without either."""
    d = F.transform(points, lambda p: F.struct(dist(vec(p), vec(to)).alias("d"), p.alias("p")))
    return F.try_element_at(F.array_sort(d), F.lit(1))


def substitute_backbone(rows: DataFrame) -> DataFrame:
    """Fused residues without N, CA and C of their own: N the nitrogen nearest the previous C, C the carbon nearest the
    next N, both within 2.5, CA the other carbon nearest that N. They are flagged linked."""
    d = _chain(rows).neighbour(["c"], "prev_").neighbour(["n"], "next_", ahead=True).done()
    lack = F.col("n").isNull() | F.col("ca").isNull() | F.col("c").isNull()
    can = lack & F.col("prev_c").isNotNull() & F.col("next_n").isNotNull() & (F.size("carbons") >= 2) & (F.size("nitrogens") >= 1)
    n = F.when(can, _nearest(F.col("nitrogens"), F.col("prev_c")))
    c = F.when(can, _nearest(F.col("carbons"), F.col("next_n")))
    d = d.withColumn("_n", n).withColumn("_c", c)
    others = F.filter("carbons", lambda p: p != F.col("_c.p"))
    d = d.withColumn("_ca", _nearest(others, F.col("_n.p")))
    ok = F.coalesce((F.col("_n.d") < BOND) & (F.col("_c.d") < BOND), F.lit(False)) & F.col("_ca").isNotNull()
    put = lambda new, old: F.when(ok, F.col(new + ".p")).otherwise(F.col(old))
    d = d.withColumn("n", put("_n", "n")).withColumn("c", put("_c", "c")).withColumn("ca", put("_ca", "ca")).withColumn("linked", ok)
    return d.drop("_n", "_c", "_ca", "prev_c", "next_n")


def rebuild_oxygen(rows: DataFrame) -> DataFrame:
    """A missing O is set 1.231 from C, opposite the bisector of C->CA and C->N(next); without a bonded successor the
    residue goes."""
    d = _chain(rows).neighbour(["n"], "next_", ahead=True).done()
    c = vec("c")
    bonded = F.coalesce(dist(vec("next_n"), c) < BOND, F.lit(False))
    way = vec("ca").minus(c).unit().plus(vec("next_n").minus(c).unit()).unit()
    built = c.minus(way.times(CO)).struct()
    o = F.coalesce(F.col("o"), F.when(bonded, built))
    return d.withColumn("o", o).filter("o is not null").drop("next_n")


def drop_free_hetero(rows: DataFrame) -> DataFrame:
    """HETATM residues stay only where a peptide bond joins them to a neighbour."""
    d = _chain(rows).neighbour(["c"], "prev_").neighbour(["n"], "next_", ahead=True).done()
    near = lambda a, b: F.coalesce(dist(vec(a), vec(b)) < BOND, F.lit(False))
    keep = ~F.col("het") | near("prev_c", "n") | near("c", "next_n")
    return d.filter(keep).drop("prev_c", "next_n")


def backbone(atoms: DataFrame) -> DataFrame:
    """Residues with a whole backbone, in order, with `k` (place in the entry) and `prev` (bonded to the one before)."""
    rows = cut(substitute_backbone(residue_rows(atoms)))
    rows = rows.filter("n is not null and ca is not null and c is not null").drop("carbons", "nitrogens")
    rows = cut(rebuild_oxygen(drop_free_hetero(rows)))
    o = Ordered(rows, ["entry"], ["idx"], block_of(F.col("idx"))).row_number("_rn").neighbour(["chain", "c"], "prev_")
    near = F.coalesce((F.col("prev_chain") == F.col("chain")) & (dist(vec("prev_c"), vec("n")) < BOND), F.lit(False))
    d = o.with_column("prev", near).with_column("k", F.col("_rn") - 1).done()
    return d.drop("_rn", "prev_chain", "prev_c")


def amide_hydrogen(residues: DataFrame) -> DataFrame:
    """Residues with `h`: one unit from N along C(i-1) - O(i-1); null for proline and after a break."""
    d = _chain(residues, "k", ("entry",)).neighbour(["c", "o"], "prev_").done()
    way = vec("prev_c").minus(vec("prev_o")).unit()
    has = F.col("prev") & (F.col("resname") != "PRO")
    return d.withColumn("h", F.when(has, vec("n").plus(way).struct())).drop("prev_c", "prev_o")


#: acceptors tried together, at first and at most
SLICE = (512, 4096)
FLOOR = -9.9
#: points of either side in a call, and cells of the reach that a point's neighbourhood in a block is taken for
CROWD, CELLS = 16384, 32


def _two_best(d: dict[str, np.ndarray], a: dict[str, np.ndarray], reach: float, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of donors and acceptors, and the energy, of each donor's two best bonds. Acceptors are tried in their order, some at a time, and a
    donor with two bonds of the least energy there is leaves: no later one can be better."""
    place = lambda t, c: np.stack([t[c + x] for x in "xyz"], axis=1)
    order = np.argsort(a["k"], kind="stable")
    a = {k: v[order] for k, v in a.items()}
    (ca, nn, h), (cb, cc, oo) = [place(d, c) for c in ("", "n", "h")], [place(a, c) for c in ("", "c", "o")]
    n = len(ca)
    energy, who = np.full((n, 2), np.inf), np.full((n, 2), -1)
    open_, lo, size = np.arange(n), 0, SLICE[0]
    away = lambda p, q: np.sqrt(np.square(p[:, 0] - q[:, 0]) + np.square(p[:, 1] - q[:, 1]) + np.square(p[:, 2] - q[:, 2]))
    while lo < len(cb) and len(open_):
        other = np.arange(lo, min(len(cb), lo + size))
        for at in range(0, len(open_), 256):
            some = open_[at : at + 256]
            mid = ca[some[0]]
            p, q = ca[some] - mid, cb[other] - mid
            sq = p @ (-2.0 * q.T)
            sq += (p * p).sum(axis=1)[:, None]
            sq += (q * q).sum(axis=1)[None, :]
            i, j = np.nonzero(sq <= (reach + 0.002) ** 2)
            i, j = some[i], other[j]
            ok = (d["k"][i] != a["k"][j]) & ~((a["k"][j] == d["k"][i] - 1) & d["prev"][i])
            ok[ok] &= np.floor(away(ca[i[ok]], cb[j[ok]]) * 1000.0 + 0.5) / 1000.0 <= reach
            i, j = i[ok], j[ok]
            on, ch, oh, cn = away(oo[j], nn[i]), away(cc[j], h[i]), away(oo[j], h[i]), away(cc[j], nn[i])
            with np.errstate(divide="ignore", invalid="ignore"):
                e = np.floor(27.888 * (1.0 / on + 1.0 / ch - 1.0 / oh - 1.0 / cn) * 1000.0 + 0.5) / 1000.0 + 0.0
            e = np.where(np.fmin(np.fmin(on, ch), np.fmin(oh, cn)) < 0.5, FLOOR, np.fmax(FLOOR, e))
            # of equal ones the earlier acceptor stays
            ok = (e < most) & (e < energy[i, 1])
            i, j, e = i[ok], j[ok], e[ok]
            of = np.unique(i)
            i, j, e = [np.concatenate(v) for v in ((i, np.repeat(of, 2)), (j, who[of].ravel()), (e, energy[of].ravel()))]
            rank = np.lexsort((j, e, i))
            i, j, e = i[rank], j[rank], e[rank]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            energy[of, 0], who[of, 0], energy[of, 1], who[of, 1] = e[first], j[first], e[first + 1], j[first + 1]
        open_ = open_[energy[open_, 1] > FLOOR]
        lo, size = lo + size, min(2 * size, SLICE[1])
    i, t = np.nonzero(np.isfinite(energy))
    return i, order[who[i, t]], energy[i, t]


def _bonding(reach: float, most: float, group: str):
    def bonds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lists = [batch.column(c)[row].values for c in "ab"]
                d, a = [{f.name: t.field(f.name).to_numpy(zero_copy_only=False) for f in t.type} for t in lists]
                i, j, e = _two_best(d, a, reach, most)
                first = pa.array([batch.column(group)[row].as_py()] * len(i), batch.schema.field(group).type)
                yield pa.RecordBatch.from_arrays([first, lists[1].field("k").take(pa.array(j)), lists[0].field("k").take(pa.array(i)), pa.array(e)], [group, "acceptor", "donor", "energy"])

    return bonds


def hbonds_backbone(residues: DataFrame, reach: float = 9.0, most: float = -0.5) -> DataFrame:
    """entry, acceptor, donor, energy: each NH's two best acceptors below -0.5 kcal/mol, the lower acceptor on a tie.

    Donors meet acceptors block by block and no pair is a row but two of a donor in each call. Where residues are crowded, acceptors are offered in
    their order, in rounds of four times as many: a donor that has two bonds of the least energy there is goes on no more."""
    d = amide_hydrogen(residues)
    flat = lambda **c: [F.col(f"{v}.{x}").alias(k + x) for k, v in c.items() for x in "xyz"]
    at = [F.col("ca." + c).alias(c) for c in "xyz"]
    donors = d.filter("h is not null").select("entry", "k", "prev", *at, *flat(n="n", h="h"))
    acc = residues.select("entry", "k", *at, *flat(c="c", o="o"))
    kind = residues.schema["k"].dataType.simpleString()
    shape = f"entry {residues.schema['entry'].dataType.simpleString()}, acceptor {kind}, donor {kind}, energy double"
    best = lambda d: first_by(d, ["entry", "donor"], [F.col("energy"), F.col("acceptor")], 2).drop("rank")
    among = lambda d, a: blocks_meeting(d, a, reach, idx="k", crowd=CROWD).mapInArrow(_bonding(reach, most, "entry"), shape)
    cells = [F.floor(F.col(c) / F.lit(reach)) for c in "xyz"]
    fullest = acc.groupBy("entry", *cells).count().agg(F.max("count")).first()[0] or 0
    if fullest * CELLS <= CROWD:
        return best(among(donors, acc))
    ends = acc.groupBy("entry").agg(F.min("k").alias("_lo"), F.max("k").alias("_hi"))
    acc = cut(acc.join(ends, "entry").withColumn("_at", (F.col("k") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1)).drop("_lo", "_hi"))
    donors, found, lo, hi = cut(donors), None, 0.0, CROWD / (fullest * CELLS)
    while hi < 1.0:
        now = cut(best(among(donors, acc.filter((F.col("_at") >= lo) & (F.col("_at") < hi)).drop("_at"))))
        found = now if found is None else found.unionByName(now)
        full = found.filter(F.col("energy") == FLOOR).groupBy("entry", F.col("donor").alias("k")).count().filter("count > 1")
        donors = cut(donors.join(full.select("entry", "k"), ["entry", "k"], "left_anti"))
        lo, hi = hi, hi * 4
    return best(found.unionByName(among(donors, acc.filter(F.col("_at") >= lo).drop("_at"))))


def with_breaks(residues: DataFrame) -> DataFrame:
    """entry, k, brk: a running count of chain breaks, so `a` to `b` is unbroken when their counts are equal."""
    return _chain(residues.select("entry", "k", "prev"), "k", ("entry",)).islands(~F.col("prev"), "brk").done()


def turns(hbonds: DataFrame, breaks: DataFrame) -> DataFrame:
    """entry, k, turn (3, 4 or 5): the CO of k is bonded to the NH of k + turn and the chain is whole between."""
    t = hbonds.select("entry", F.col("acceptor").alias("k"), F.col("donor").alias("end"), (F.col("donor") - F.col("acceptor")).alias("turn"))
    t = t.filter(F.col("turn").isin(3, 4, 5))
    a = breaks.select("entry", "k", F.col("brk").alias("b0"))
    b = breaks.select("entry", F.col("k").alias("end"), F.col("brk").alias("b1"))
    return t.join(a, ["entry", "k"]).join(b, ["entry", "end"]).filter("b0 = b1").select("entry", "k", "turn")


def bridges(hbonds: DataFrame, breaks: DataFrame, keys: list[str] = ("entry",), apart: int = 3) -> DataFrame:
    """keys, i, j, kind: the parallel pattern first, else the antiparallel one, i < j by at least three, both with
    bonded neighbours. Only places next to a bond are tried, by four equi-joins on the bonds."""
    g = list(keys)
    h = hbonds.select(*g, F.col("acceptor").alias("a"), F.col("donor").alias("d")).distinct()
    sh = lambda da, dd: h.select(*g, (F.col("a") + da).alias("i"), (F.col("d") + dd).alias("j"))
    rev = lambda da, dd: h.select(*g, (F.col("d") + dd).alias("i"), (F.col("a") + da).alias("j"))
    # bond (x, y) read as a condition on (i, j): (i-1, j) -> i = a+1, j = d, and so on
    par = sh(1, 0).join(rev(0, -1), [*g, "i", "j"], "left_semi").union(rev(1, 0).join(sh(0, -1), [*g, "i", "j"], "left_semi"))
    anti = sh(0, 0).join(rev(0, 0), [*g, "i", "j"], "left_semi").union(sh(1, -1).join(rev(1, -1), [*g, "i", "j"], "left_semi"))
    one = par.distinct().withColumn("kind", F.lit("P")).union(anti.distinct().withColumn("kind", F.lit("A")))
    one = one.filter(F.col("j") >= F.col("i") + apart).groupBy(*g, "i", "j").agg(F.max("kind").alias("kind"))
    inner = breaks.select(*g, "k", "brk")
    around = inner.join(inner.select(*g, (F.col("k") + 1).alias("k"), F.col("brk").alias("before")), [*g, "k"])
    around = around.join(inner.select(*g, (F.col("k") - 1).alias("k"), F.col("brk").alias("after")), [*g, "k"])
    around = around.filter("before = brk and after = brk").select(*g, "k")
    ok = one.join(around.withColumnRenamed("k", "i"), [*g, "i"], "left_semi")
    return ok.join(around.withColumnRenamed("k", "j"), [*g, "j"], "left_semi").select(*g, "i", "j", "kind")


def ladders(br: DataFrame, breaks: DataFrame, keys: list[str] = ("entry",)) -> DataFrame:
    """keys, kind, i0, i1, j0, j1, n: runs of consecutive bridges of one kind along a diagonal, unbroken in i."""
    g = list(keys)
    d = br.join(breaks.select(*g, F.col("k").alias("i"), "brk"), [*g, "i"])
    d = d.withColumn("diag", F.when(F.col("kind") == "P", F.col("j") - F.col("i")).otherwise(F.col("i") + F.col("j")))
    line = [*g, "kind", "diag", "brk"]
    o = Ordered(d, line, ["i"], block_of(F.col("i"))).neighbour(["i"], "prev_")
    o = o.islands(F.col("prev_i").isNull() | (F.col("prev_i") != F.col("i") - 1), "_run").done()
    return o.groupBy(*line, "_run").agg(
        F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"), F.count(F.lit(1)).alias("n")
    ).select(*g, "kind", "i0", "i1", "j0", "j1", "n")


def bulge_join(lad: DataFrame, breaks: DataFrame, keys: list[str] = ("entry",)) -> DataFrame:
    """Ladders of one kind joined across a bulge, with `bulged`. Each ladder, first residue first, takes the next later
    one it can join and goes on from the grown ladder; a round joins every ladder that no earlier one can still take.

    Only ladders whose first residues lie within six of the end are compared: the join is keyed by that window."""
    g = list(keys)
    state = cut(lad.withColumn("bulged", F.lit(False)))
    b = breaks.select(*g, "k", "brk")
    at = lambda d, c, n: d.join(b.select(*g, F.col("k").alias(c), F.col("brk").alias(n)), [*g, c])
    while True:
        x = state.select(*g, "kind", *[F.col(c).alias("x" + c) for c in ("i0", "i1", "j0", "j1", "n")],
                         F.explode(F.sequence(F.col("i1") , F.col("i1") + 5)).alias("i0"))
        y = state.select(*g, "kind", "i0", *[F.col(c).alias("y" + c) for c in ("i0", "i1", "j0", "j1", "n")])
        p = x.join(y, [*g, "kind", "i0"]).filter("xi0 < yi0 or (xi0 = yi0 and xj0 < yj0)")
        p = p.filter("not (xi1 >= yi0 and xi0 <= yi1)")
        par = F.col("kind") == "P"
        gap = lambda m, n: F.when(m >= n, m - n).otherwise(F.lit(1 << 30))
        gi = gap(F.col("yi0"), F.col("xi1"))
        go = F.when(par, gap(F.col("yj0"), F.col("xj1"))).otherwise(gap(F.col("xj0"), F.col("yj1")))
        p = p.filter((gi < 6) & (((go < 6) & (gi < 3)) | (go < 3)))
        p = p.withColumn("lo_j", F.least("xj0", "yj0")).withColumn("hi_j", F.greatest("xj1", "yj1"))
        p = at(at(p, "xi0", "b0"), "yi1", "b1").filter("b0 = b1").drop("b0", "b1")
        p = at(at(p, "lo_j", "b0"), "hi_j", "b1").filter("b0 = b1").drop("b0", "b1")
        # each ladder's first joinable partner, in ladder order
        best = p.groupBy(*g, "kind", "xi0", "xj0", "xi1", "xj1").agg(F.min(F.struct("yi0", "yj0", "yi1", "yj1", "yn", "xn")).alias("t"))
        best = cut(best.select(*g, "kind", "xi0", "xj0", "xi1", "xj1", "t.*"))
        if best.isEmpty():
            return state
        # a ladder that another takes this round waits; of several takers the first takes
        taker = best.groupBy(*g, "kind", "yi0", "yj0").agg(F.min(F.struct("xi0", "xj0")).alias("f"))
        ready = best.join(taker, [*g, "kind", "yi0", "yj0"]).filter((F.col("f.xi0") == F.col("xi0")) & (F.col("f.xj0") == F.col("xj0"))).drop("f")
        taken = best.select(*g, "kind", F.col("yi0").alias("xi0"), F.col("yj0").alias("xj0")).distinct()
        ready = cut(ready.join(taken, [*g, "kind", "xi0", "xj0"], "left_anti"))
        gone = ready.select(*g, "kind", F.col("xi0").alias("i0"), F.col("xj0").alias("j0")).union(ready.select(*g, "kind", F.col("yi0").alias("i0"), F.col("yj0").alias("j0")))
        # the x ladder's own low j may be the partner's in an antiparallel pair, so match on the ladder's (i0, j0)
        grown = ready.select(*g, "kind", F.col("xi0").alias("i0"), F.greatest("xi1", "yi1").alias("i1"), F.least("xj0", "yj0").alias("j0"),
                             F.greatest("xj1", "yj1").alias("j1"), (F.col("xn") + F.col("yn")).alias("n"), F.lit(True).alias("bulged"))
        state = cut(state.join(gone, [*g, "kind", "i0", "j0"], "left_anti").unionByName(grown))


def assign_codes(residues: DataFrame, lad: DataFrame, turn: DataFrame, prefer_pi: bool = True) -> DataFrame:
    """entry, k, code. The passes of the published order: E and B, H over them, G then I where the whole segment is
    free, T inside turns. Within a pass segments of G (or I) see what the pass before it left."""
    cells = residues.select("entry", "k")
    arm = lambda a, b: lad.select("entry", F.explode(F.sequence(a, b)).alias("k"), F.when(F.col("n") > 1, F.lit(2)).otherwise(F.lit(1)).alias("e"))
    e = arm("i0", "i1").union(arm("j0", "j1")).groupBy("entry", "k").agg(F.max("e").alias("e"))

    def segments(n: int) -> DataFrame:
        t = turn.filter(F.col("turn") == n).select("entry", "k")
        both = t.join(t.select("entry", (F.col("k") + 1).alias("k")), ["entry", "k"], "left_semi")
        return both.select("entry", F.col("k").alias("seg"), F.explode(F.sequence(F.col("k"), F.col("k") + n - 1)).alias("k"))

    mark = lambda d, name: d.select("entry", "k").distinct().withColumn(name, F.lit(1))
    s = cells.join(e, ["entry", "k"], "left").join(mark(segments(4), "h"), ["entry", "k"], "left")
    code = F.when(F.col("h") == 1, "H").when(F.col("e") == 2, "E").when(F.col("e") == 1, "B").otherwise("-")
    s = cut(s.select("entry", "k", code.alias("code")))
    for n, letter, free in ((3, "G", ["-", "G"]), (5, "I", ["-", "I", "H"] if prefer_pi else ["-", "I"])):
        seg = segments(n).join(s, ["entry", "k"])
        whole = seg.groupBy("entry", "seg").agg(F.bool_and(F.col("code").isin(free)).alias("ok")).filter("ok")
        on = mark(seg.join(whole, ["entry", "seg"], "left_semi"), "on")
        s = cut(s.join(on, ["entry", "k"], "left").select("entry", "k", F.when(F.col("on") == 1, F.lit(letter)).otherwise(F.col("code")).alias("code")))
    inside = turn.select("entry", F.explode(F.sequence(F.col("k") + 1, F.col("k") + F.col("turn") - 1)).alias("k"))
    s = s.join(mark(inside, "t"), ["entry", "k"], "left")
    return s.select("entry", "k", F.when((F.col("code") == "-") & (F.col("t") == 1), F.lit("T")).otherwise(F.col("code")).alias("code"))


def secondary_structure(residues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(codes, bridges) of every entry."""
    r = cut(residues)
    hb = cut(hbonds_backbone(r))
    brk = cut(with_breaks(r))
    br = cut(bridges(hb, brk))
    lad = bulge_join(ladders(br, brk), brk)
    return assign_codes(r, lad, turns(hb, brk)), br


# ---------------------------------------------------------------- elements
def elements(residues: DataFrame, codes: DataFrame, short_helices: bool = True) -> DataFrame:
    """Strands of two E or more; helices of H, G and I with four H or six residues; lone 3-10 runs of three or more.

    entry, element (CHAIN:first-last), kind, chain, k0, k1, residues, first, last (seq and icode), centroid, axis."""
    d = residues.join(codes, ["entry", "k"])
    cls = F.when(F.col("code") == "E", F.lit("E")).when(F.col("code").isin("H", "G", "I"), F.lit("H"))
    o = _chain(d.withColumn("cls", cls), "k", ("entry",)).neighbour(["cls"], "prev_")
    o = o.islands(~F.col("prev") | ~F.col("prev_cls").eqNullSafe(F.col("cls")), "_run")
    r = o.done().filter("cls is not null")
    ca = vec("ca")
    sums = [F.sum(p * q) for p, q in ((ca.x, ca.x), (ca.x, ca.y), (ca.x, ca.z), (ca.y, ca.y), (ca.y, ca.z), (ca.z, ca.z))]
    g = r.groupBy("entry", "_run", "cls").agg(
        F.min("k").alias("k0"), F.max("k").alias("k1"), F.count(F.lit(1)).alias("residues"), F.min("chain").alias("chain"),
        F.count_if(F.col("code") == "H").alias("n_h"), F.count_if(F.col("code") == "G").alias("n_g"),
        F.min_by(F.struct("seq", "icode", "ca"), "k").alias("first"), F.max_by(F.struct("seq", "icode", "ca"), "k").alias("last"),
        F.avg(ca.x).alias("mx"), F.avg(ca.y).alias("my"), F.avg(ca.z).alias("mz"), F.array(*sums).alias("_s"),
    )
    only_g = (F.col("n_g") == F.col("residues")) & (F.col("residues") >= 3)
    helix = (F.col("n_h") >= 4) | (F.col("residues") >= 6)
    kind = F.when((F.col("cls") == "E") & (F.col("residues") >= 2), "E").when((F.col("cls") == "H") & only_g & ~(F.col("n_h") > 0), F.lit("G") if short_helices else None).when(
        (F.col("cls") == "H") & helix, "H"
    )
    g = g.withColumn("kind", kind).filter("kind is not null")
    n, m = F.col("residues"), ["mx", "my", "mz"]
    idx = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
    cov = F.array(*[F.col("_s")[t] - n * F.col(m[i]) * F.col(m[j]) for t, (i, j) in enumerate(idx)])
    g = g.withColumn("_e", eig3(cov))
    v = F.col("_e.vectors")
    way = Vec(v[6], v[7], v[8])
    along = way.dot(vec(F.col("last.ca")).minus(vec(F.col("first.ca"))))
    axis = way.times(F.when(along < 0, F.lit(-1.0)).otherwise(F.lit(1.0)))
    tag = lambda e: F.concat(F.col(e + ".seq").cast("string"), F.col(e + ".icode"))
    name = F.concat(F.col("chain"), F.lit(":"), tag("first"), F.lit("-"), tag("last"))
    return g.select(
        "entry", name.alias("element"), "kind", "chain", "k0", "k1", "residues", F.struct("first.seq", "first.icode").alias("first"),
        F.struct("last.seq", "last.icode").alias("last"), Vec(*[F.col(c) for c in m]).struct().alias("centroid"), axis.struct().alias("axis"),
    )


def generic_label(kind: Column, n: Column) -> Column:
    """Label of a chain's n-th (from 0) element of a kind: strands A to Z then S27, 3-10 helices with eta, helices alpha."""
    strand = F.when(n < 26, F.char(F.lit(65) + n)).otherwise(F.concat(F.lit("S"), n + 1))
    return F.when(kind == "E", strand).when(kind == "G", F.concat(F.lit("η"), n + 1)).otherwise(F.concat(F.lit("α"), n + 1))


def labels(elements_: DataFrame, order: str = "k0", keys: tuple = ("entry", "chain")) -> DataFrame:
    """Elements with `label`, numbered along their chain by kind."""
    o = Ordered(elements_, [*keys, "kind"], [order], block_of(F.col(order))).row_number("_n").done()
    return o.withColumn("label", generic_label(F.col("kind"), F.col("_n") - 1)).drop("_n")


def kink_angles(residues: DataFrame, elements_: DataFrame, window: int = 4) -> DataFrame:
    """entry, element, k, axis: local helix axes from the bisectors of successive CA triplets, to place kinks."""
    d = _chain(residues, "k", ("entry",)).neighbour(["ca"], "p_").neighbour(["ca"], "n_", ahead=True).done()
    ca = vec("ca")
    bis = vec("p_ca").minus(ca).plus(vec("n_ca").minus(ca))
    d = d.withColumn("bis", bis.struct())
    from molframe.plans.intervals import points_in

    h = elements_.filter("kind = 'H'").select("entry", "element", "k0", "k1")
    inside = points_in(d.select("entry", "k", "code", "bis") if "code" in d.columns else d.select("entry", "k", "bis"), h, ["entry"], "k", "k0", "k1")
    inside = inside.filter("k > k0 and k < k1")
    o = Ordered(inside, ["entry", "element"], ["k"], block_of(F.col("k"))).neighbour(["bis"], "n_", ahead=True).done()
    return o.filter("n_bis is not null").withColumn("axis", vec("bis").cross(vec("n_bis")).unit().struct()).drop("n_bis", "bis")


def split_kinks(residues: DataFrame, codes: DataFrame, elements_: DataFrame, most: float = 30.0, arm: int = 7) -> DataFrame:
    """Places (entry, element, k) before which a helix is cut: two H arms of at least seven that meet through G or I
    only, with more than 30 degrees between their mean local axes."""
    from molframe.functions.geom import vec_angle
    from molframe.plans.intervals import points_in

    h = elements_.filter("kind = 'H'").select("entry", "element", "k0", "k1")
    c = points_in(codes, h, ["entry"], "k", "k0", "k1")
    o = Ordered(c, ["entry", "element"], ["k"], block_of(F.col("k"))).neighbour(["code"], "prev_")
    is_h = F.col("code") == "H"
    o = o.islands(F.col("prev_code").isNull() | ((F.col("prev_code") == "H") != is_h), "_run").done()
    ax = kink_angles(residues, elements_).select("entry", "element", "k", "axis")
    j = o.join(ax, ["entry", "element", "k"], "left")
    r = j.groupBy("entry", "element", "_run").agg(
        F.min("k").alias("a"), F.max("k").alias("b"), F.max(is_h.cast("int")).alias("h"), *[F.avg("axis." + c).alias("m" + c) for c in "xyz"]
    )
    arms = r.filter(f"h = 1 and b - a + 1 >= {arm}").withColumn("m", Vec(F.col("mx"), F.col("my"), F.col("mz")).struct())
    w = Ordered(arms, ["entry", "element"], ["a"], block_of(F.col("a"))).neighbour(["_run", "b", "m"], "prev_").done()
    bent = w.filter((F.col("prev__run") == F.col("_run") - 2) & (snap(vec_angle(vec("prev_m"), vec("m"))) > most))
    return bent.select("entry", "element", F.floor((F.col("prev_b") + F.col("a") + 1) / 2).cast("bigint").alias("k"))


def join_bulged(strands: DataFrame, br: DataFrame, breaks: DataFrame, most: int = 4) -> DataFrame:
    """Strands (entry, element, k0, k1) with `strand`: pieces one to four apart, unbroken, that pair with one partner
    strand are one. Pieces are joined along the chain, so a running count of openings names the whole."""
    from molframe.plans.intervals import points_in

    own = strands.select("entry", "element", "k0", "k1")
    two = br.select("entry", "i", "j").union(br.select("entry", F.col("j").alias("i"), F.col("i").alias("j")))
    p = points_in(two, own, ["entry"], "i", "k0", "k1").drop("k0", "k1").withColumnRenamed("element", "a")
    p = points_in(p, own, ["entry"], "j", "k0", "k1").select("entry", "a", F.col("element").alias("b")).filter("a <> b").distinct()
    partners = p.groupBy("entry", F.col("a").alias("element")).agg(F.collect_set("b").alias("partners"))
    d = own.join(partners, ["entry", "element"], "left").join(breaks.select("entry", F.col("k").alias("k0"), F.col("brk").alias("b0")), ["entry", "k0"])
    o = Ordered(d, ["entry"], ["k0"], block_of(F.col("k0"))).neighbour(["k1", "b0", "partners"], "prev_")
    gap = F.col("k0") - F.col("prev_k1") - 1
    same = (gap >= 1) & (gap <= most) & (F.col("b0") == F.col("prev_b0")) & F.coalesce(F.arrays_overlap("partners", "prev_partners"), F.lit(False))
    out = o.islands(~F.coalesce(same, F.lit(False)), "strand").done()
    return out.select("entry", "element", "k0", "k1", "strand")


def copy_breaks(helices: DataFrame, copies: DataFrame, most: int = 2) -> DataFrame:
    """Gaps of at most two residues between helix pieces, per group of copies: `joined` when most copies that have both
    sides are whole there, a tie leaves it broken. helices: entry, chain, first, last on the group's numbering."""
    h = helices.join(copies.select("entry", "chain", "copy_group"), ["entry", "chain"])
    o = Ordered(h, ["entry", "chain"], ["first"], block_of(F.col("first") + 100000)).neighbour(["last"], "prev_").done()
    gap = F.col("first") - F.col("prev_last") - 1
    cuts = o.filter((gap >= 1) & (gap <= most)).select("entry", "copy_group", "chain", F.col("prev_last").alias("a"), F.col("first").alias("b"))
    places = cuts.select("entry", "copy_group", "a", "b").distinct()
    from molframe.plans.intervals import spans_meeting

    m = spans_meeting(places.withColumnRenamed("a", "first").withColumnRenamed("b", "last"), h.select("entry", "copy_group", "chain", "first", "last"), ["entry", "copy_group"], "first", "last")
    whole = m.filter("first_b <= first_a and last_b >= last_a").groupBy("entry", "copy_group", F.col("first_a").alias("a"), F.col("last_a").alias("b")).agg(F.countDistinct("chain_b").alias("whole"))
    broken = cuts.groupBy("entry", "copy_group", "a", "b").agg(F.countDistinct("chain").alias("broken"))
    out = broken.join(whole, ["entry", "copy_group", "a", "b"], "left").fillna(0, ["whole"])
    return out.withColumn("joined", F.col("whole") > F.col("broken"))


def match_breaks(helices: DataFrame, copies: DataFrame, most: int = 2, least: int = 6) -> DataFrame:
    """Helices (entry, chain, first, last) broken alike in all copies, with `change`: cut, joined or null.

    Where copies differ in a gap of at most `most` residues, most copies decide and a tie breaks: whole helices are cut
    there if both pieces keep `least` residues, or the pieces are joined, also across several gaps. A joined helix is not
    cut. first and last are on the numbering of the group of copies; chains in no group stay as they are."""
    from molframe.plans.intervals import spans_meeting

    chain = ["entry", "copy_group", "chain"]
    decided = cut(copy_breaks(helices, copies, most).filter("whole > 0").select("entry", "copy_group", "a", "b", "joined"))
    h = helices.select("entry", "chain", "first", "last").join(copies.select("entry", "chain", "copy_group"), ["entry", "chain"], "left")
    place = block_of(F.col("first") + 100000)
    o = Ordered(h, ["entry", "chain"], ["first"], place).neighbour(["last"], "prev_").done()
    joins = decided.filter("joined").select("entry", "copy_group", F.col("a").alias("prev_last"), F.col("b").alias("first"), F.lit(True).alias("held"))
    o = o.join(joins, ["entry", "copy_group", "prev_last", "first"], "left")
    o = Ordered(o, ["entry", "chain"], ["first"], place).islands(F.col("held").isNull(), "_run").done()
    runs = cut(o.groupBy(*chain, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("pieces")))
    places = decided.filter("not joined").select("entry", "copy_group", F.col("a").alias("first"), F.col("b").alias("last"))
    met = spans_meeting(places, runs.filter("pieces = 1").drop("pieces"), ["entry", "copy_group"], "first", "last").filter("first_b <= first_a and last_b >= last_a")
    # a helix has fewer cuts than residues
    cuts = met.groupBy("entry", "copy_group", F.col("chain_b").alias("chain"), F.col("_run_b").alias("_run")).agg(F.array_sort(F.collect_list(F.struct(F.col("first_a").cast("long").alias("a"), F.col("last_a").cast("long").alias("b")))).alias("cuts"))
    # a chain in no group has a null group, which meets none
    r = runs.join(cuts, [*chain, "_run"], "left").withColumn("first", F.col("first").cast("long")).withColumn("last", F.col("last").cast("long"))
    piece = lambda a, b: F.struct(a.alias("first"), b.alias("last"))

    def step(acc: Column, c: Column) -> Column:
        fits = (c["a"] - acc["start"] + 1 >= least) & (F.col("last") - c["b"] + 1 >= least)
        return F.when(fits, F.struct(c["b"].alias("start"), F.concat(acc["done"], F.array(piece(acc["start"], c["a"]))).alias("done"))).otherwise(acc)

    none = F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")
    start = F.struct(F.col("first").alias("start"), none.alias("done"))
    pieces = F.aggregate("cuts", start, step, lambda acc: F.concat(acc["done"], F.array(piece(acc["start"], F.col("last")))))
    out = r.withColumn("_p", F.when(F.col("cuts").isNull(), F.array(piece(F.col("first"), F.col("last")))).otherwise(pieces))
    change = F.when(F.col("pieces") > 1, "joined").when(F.size("_p") > 1, "cut")
    return out.select("entry", "chain", change.alias("change"), F.explode("_p").alias("_p")).select("entry", "chain", "_p.first", "_p.last", "change")
