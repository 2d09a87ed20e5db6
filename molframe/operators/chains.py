"""Residues in chain order: runs, breaks, nearest labels, flanks, boundaries. All in two-level windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.plans.intervals import points_in, spans_meeting
from molframe.plans.ordered import Ordered, block_of, runs
from molframe.session import cut


def code_runs(df: DataFrame, keys: list[str], order: list[str], block: Column, code: str, broken: Column | None = None) -> DataFrame:
    """One row per maximal run: keys, run, code, residues, first and last of the order column."""
    r = runs(df, keys, order, block, code, broken)
    lead = order[0]
    return r.groupBy(*keys, "run").agg(
        F.first(code).alias(code), F.count(F.lit(1)).alias("residues"), F.min(lead).alias("first"), F.max(lead).alias("last")
    )


def split_at_gaps(df: DataFrame, keys: list[str], order: list[str], block: Column, gap: Column) -> DataFrame:
    """`df` with strand (from 1) and `missing`, the gap before each row; `gap` may use prev_ columns of the order
    column and is true where a new strand opens."""
    o = Ordered(df, keys, order, block).neighbour(order, "prev_")
    return o.islands(F.col("prev_" + order[0]).isNull() | F.coalesce(gap, F.lit(False)), "strand").done()


def peptide_link(df: DataFrame, keys: list[str], order: list[str], block: Column, linked: Column, cols: list[str]) -> DataFrame:
    """`df` with `prev`: whether the row is bonded to the one before; `linked` reads prev_<cols>."""
    o = Ordered(df, keys, order, block).neighbour(cols, "prev_").done()
    return o.withColumn("prev", F.coalesce(linked, F.lit(False))).drop(*["prev_" + c for c in cols])


def nearest_label(df: DataFrame, keys: list[str], pos: str, order: list[str], block: Column, label: str) -> DataFrame:
    """`label` of the nearest labelled row where it is null; the earlier on a tie."""
    here = F.when(F.col(label).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(label).alias("l")))
    o = Ordered(df.withColumn("_here", here), keys, order, block)
    d = o.carry(F.col("_here"), "_back").carry(F.col("_here"), "_next", ahead=True).done()
    back, ahead = F.col(pos) - F.col("_back.p"), F.col("_next.p") - F.col(pos)
    pick = F.when(ahead.isNull() | (back <= ahead), F.col("_back.l")).otherwise(F.col("_next.l"))
    return d.withColumn("nearest", F.coalesce(pick, F.col("_next.l"))).drop("_here", "_back", "_next")


def label_boundaries(df: DataFrame, keys: list[str], pos: str, order: list[str], block: Column, label: str) -> DataFrame:
    """keys, at: midpoints where the label of consecutive rows changes."""
    o = Ordered(df, keys, order, block).neighbour([pos, label], "prev_").done()
    change = o.filter(F.col("prev_" + label).isNotNull() & (F.col("prev_" + label) != F.col(label)))
    return change.select(*keys, ((F.col(pos) + F.col("prev_" + pos)) / 2.0).alias("at"))


def near_marks(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Marks of `a` (keys, at) with a mark of `b` within `tolerance`: equi-join on buckets a tolerance wide."""
    bucket = lambda c: F.floor(c / F.lit(float(tolerance))).cast("bigint")
    x = a.select(*keys, "at").distinct().withColumn("_b", F.explode(F.array(*[bucket(F.col("at")) + k for k in (-1, 0, 1)])))
    y = b.select(*keys, F.col("at").alias("other")).distinct().withColumn("_b", bucket(F.col("other")))
    j = x.join(y, [*keys, "_b"]).filter(F.abs(F.col("at") - F.col("other")) <= tolerance)
    return j.select(*keys, "at").distinct()


def boundary_scores(ref: DataFrame, auto: DataFrame, chains: DataFrame, keys: list[str], tolerance: float = 20.0) -> DataFrame:
    """Recall, precision and F1 of boundaries (keys, at) per chain; a side without boundaries scores 1, automatic
    ones against none score 0."""
    n = lambda d, name: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    out = chains.select(*keys).distinct()
    for d, name in ((ref, "n_ref"), (auto, "n_auto"), (near_marks(ref, auto, keys, tolerance), "found"), (near_marks(auto, ref, keys, tolerance), "right")):
        out = out.join(n(d, name), keys, "left")
    out = out.fillna(0, ["n_ref", "n_auto", "found", "right"])
    recall = F.when(F.col("n_ref") > 0, F.col("found") / F.col("n_ref")).otherwise(F.lit(1.0))
    precision = F.when(F.col("n_auto") > 0, F.col("right") / F.col("n_auto")).when(F.col("n_ref") == 0, 1.0).otherwise(0.0)
    out = out.withColumn("recall", recall).withColumn("precision", precision)
    total = F.col("recall") + F.col("precision")
    return out.withColumn("f1", F.when(total > 0, F.lit(2.0) * F.col("recall") * F.col("precision") / total).otherwise(0.0))


def boundary_status(ref: DataFrame, auto: DataFrame, ends: DataFrame, keys: list[str], tolerance: float = 20.0) -> DataFrame:
    """found, moved, missed and extra per chain. A reference boundary with no automatic one near may claim a free
    one between its two neighbours, the nearest, in chain order. `ends`: keys, size.

    Only free marks between two reference boundaries can be claimed by either of them, so claims are settled in
    rounds: a boundary claims once the one before it is settled."""
    found = near_marks(ref, auto, keys, tolerance)
    claimed = near_marks(auto, ref, keys, tolerance)
    free = cut(auto.select(*keys, "at").distinct().join(claimed, [*keys, "at"], "left_anti"))
    w = Window.partitionBy(*keys).orderBy("at")
    marks = ref.select(*keys, "at").distinct().withColumn("lo", F.lag("at").over(w)).withColumn("hi", F.lead("at").over(w))
    marks = marks.withColumn("k", F.row_number().over(w)).join(found.withColumn("hit", F.lit(True)), [*keys, "at"], "left").join(ends, keys)
    open_ = cut(marks.filter("hit is null").select(*keys, "at", "k", F.coalesce("lo", F.lit(-1.0)).alias("lo"), F.coalesce("hi", F.col("size").cast("double")).alias("hi")))
    n_ref = ref.select(*keys, "at").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ref"))
    n_auto = free.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_free"))
    moved = None
    while not open_.isEmpty():
        first = cut(open_.join(open_.groupBy(*keys).agg(F.min("k").alias("k")), [*keys, "k"]))
        f = free.select(*keys, F.col("at").alias("x"))
        cand = first.join(f, keys).filter("x > lo and x < hi")
        take = cand.groupBy(*keys, "at").agg(F.min(F.struct(F.abs(F.col("x") - F.col("at")).alias("d"), "x")).alias("b"))
        take = cut(take.select(*keys, "at", F.col("b.x").alias("x")))
        moved = take if moved is None else moved.unionByName(take)
        free = cut(free.join(take.select(*keys, F.col("x").alias("at")), [*keys, "at"], "left_anti"))
        open_ = cut(open_.join(first.select(*keys, "k"), [*keys, "k"], "left_anti"))
    count = lambda d, name: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    out = ends.select(*keys).join(count(found, "found"), keys, "left").join(n_ref, keys, "left").join(n_auto, keys, "left")
    out = out.join(count(moved, "moved"), keys, "left") if moved is not None else out.withColumn("moved", F.lit(0))
    out = out.fillna(0, ["found", "n_ref", "n_free", "moved"])
    return out.select(*keys, "found", F.col("moved").cast("bigint").alias("moved"), (F.col("n_ref") - F.col("found") - F.col("moved")).alias("missed"),
                      (F.col("n_free") - F.col("moved")).alias("extra"))


def no_strays(run_table: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """Runs (keys, run, label, residues) after stray inner runs joined the two equal runs around them, the first of
    each chain at a time until none is left; residues keep their chain's total."""
    r = cut(run_table.select(*keys, "run", "label", "residues"))
    w = Window.partitionBy(*keys).orderBy("run")
    while True:
        d = r.withColumn("_p", F.lag("label").over(w)).withColumn("_n", F.lead("label").over(w)).withColumn("_nr", F.lead("run").over(w)).withColumn("_pr", F.lag("run").over(w))
        stray = d.filter((F.col("_p") == F.col("_n")) & (F.col("residues") < least) & (F.col("label") != F.col("_p")))
        one = cut(stray.groupBy(*keys).agg(F.min(F.struct("run", "_pr", "_nr")).alias("b")))
        if one.isEmpty():
            return r
        j = r.join(one, keys, "left")
        inside = F.col("run").isin(F.col("b.run"), F.col("b._nr"))
        target = F.when(inside, F.col("b._pr")).otherwise(F.col("run"))
        head = F.col("run") == target
        j = j.withColumn("_t", target).groupBy(*keys, F.col("_t").alias("run")).agg(
            F.max(F.when(head, F.col("label"))).alias("label"), F.sum("residues").alias("residues")
        )
        r = cut(j)


def flank_residues(df: DataFrame, keys: list[str], seq: str, order: list[str], block: Column, inside: Column, n: int = 20) -> DataFrame:
    """Rows outside an element within `n` rows of one, with no break in numbering between."""
    d = df.withColumn("_in", inside)
    o = Ordered(d, keys, order, block).neighbour([seq], "prev_")
    o = o.islands(F.col("prev_" + seq).isNull() | (F.abs(F.col(seq) - F.col("prev_" + seq)) > 1), "_piece").row_number("_rn")
    pieced = o.done()
    k2 = [*keys, "_piece"]
    p = Ordered(pieced, k2, order, block_of(F.col("_rn")))
    here = F.when(F.col("_in"), F.col("_rn"))
    p = p.carry(here, "_back").carry(here, "_next", ahead=True).done()
    near = ((F.col("_rn") - F.col("_back")) <= n) | ((F.col("_next") - F.col("_rn")) <= n)
    return p.filter(~F.col("_in") & F.coalesce(near, F.lit(False))).select(*df.columns)


def compress_names(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str, part: int = 4096) -> DataFrame:
    """keys, part, label: names in order, equal neighbours as NAMExN, joined by '-', in parts of at most 4096 runs."""
    r = code_runs(df, keys, order, block, name)
    item = F.when(F.col("residues") > 1, F.concat(F.col(name), F.lit("x"), F.col("residues"))).otherwise(F.col(name))
    t = r.select(*keys, "run", item.alias("item")).withColumn("part", F.floor((F.col("run") - 1) / F.lit(part)).cast("bigint"))
    rows = F.array_sort(F.collect_list(F.struct("run", "item")))
    return t.groupBy(*keys, "part").agg(F.array_join(F.transform(rows, lambda x: x["item"]), "-").alias("label"))


def crop_strands(df: DataFrame, keys: list[str], pos: str, touched: DataFrame, flank: int, merge: int = 12) -> DataFrame:
    """Stretches (keys, piece, first, last, missing) of places within `flank` of a touched one; stretches with fewer
    than `merge` places between them are one; `missing` counts the places left out before each.

    `df` and `touched` hold keys and `pos`; the ends of a strand bound the stretches."""
    ends = df.groupBy(*keys).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    t = touched.select(*keys, pos).distinct().join(ends, keys)
    t = t.withColumn("lo", F.greatest(F.col(pos) - flank, F.col("_lo"))).withColumn("hi", F.least(F.col(pos) + flank, F.col("_hi")))
    o = Ordered(t, keys, [pos], block_of(F.col(pos))).neighbour(["hi"], "prev_")
    # the reach of a touched place grows with its position, so the place before has the farthest reach so far
    o = o.islands(F.col("prev_hi").isNull() | (F.col("lo") - F.col("prev_hi") - 1 >= merge), "piece")
    s = o.done().groupBy(*keys, "piece", "_lo").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    g = Ordered(s, keys, ["piece"], block_of(F.col("piece"))).neighbour(["last"], "prev_").done()
    miss = F.when(F.col("prev_last").isNull(), F.col("first") - F.col("_lo")).otherwise(F.col("first") - F.col("prev_last") - 1)
    return g.select(*keys, "piece", "first", "last", miss.alias("missing"))


def track_positions(sequence: DataFrame, modelled: DataFrame, keys: list[str], block: int = 4096) -> DataFrame:
    """Deposited positions with observed flag and author number; an unmodelled one is numbered from the nearest
    modelled one, the earlier on a tie. `sequence`: keys, pos, name, or keys, first, last, name for stretches of one name;
    `modelled`: keys, pos, number.

    Only modelled positions are put in order: each numbers the positions that are nearer to it than to its neighbours. Stretches
    become positions at the very end, so those are never sent."""
    s = sequence.withColumn("first", F.col("pos")).withColumn("last", F.col("pos")) if "first" not in sequence.columns else sequence
    s = s.select(*keys, *[F.col(c).cast("bigint").alias(c) for c in ("first", "last")], "name")
    known = points_in(modelled.filter(F.col("number").isNotNull()), s.select(*keys, "first", "last"), keys, "pos", "first", "last", block, "left_semi")
    o = Ordered(known, keys, ["pos"], block_of(F.col("pos"), block)).neighbour(["pos"], "prev_").neighbour(["pos"], "next_", ahead=True).done()
    half = lambda a, b: F.shiftright((F.col(a) + F.col(b)).cast("bigint"), 1)
    ends = s.groupBy(*keys).agg(F.min("first").alias("_lo"), F.max("last").alias("_hi"))
    o = o.join(ends, keys).select(
        *keys, F.coalesce(half("prev_pos", "pos") + 1, "_lo").alias("first"), F.coalesce(half("pos", "next_pos"), "_hi").alias("last"),
        F.col("pos").alias("at"), (F.col("number") - F.col("pos")).alias("off"), F.lit(None).cast("string").alias("name"),
    )
    d = spans_meeting(s.withColumn("at", F.lit(0)).withColumn("off", F.lit(0)), o, keys, "first", "last", block)
    d = d.select(*keys, F.greatest("first_a", "first_b").alias("first"), F.least("last_a", "last_b").alias("last"), F.col("name_a").alias("name"), F.col("at_b").alias("at"), F.col("off_b").alias("off"))
    none = s.join(o.select(*keys).distinct(), keys, "left_anti")
    d = d.unionByName(none, allowMissingColumns=True).withColumn("pos", F.explode(F.sequence("first", "last")))
    return d.select(*keys, "pos", "name", F.coalesce(F.col("at") == F.col("pos"), F.lit(False)).alias("observed"), (F.col("pos") + F.col("off")).alias("number"))
