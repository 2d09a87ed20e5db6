"""Two structures compared: codes, pairings, chains by place, elements by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molframe.plans.intervals import points_in, spans_meeting
from molframe.plans.rounds import match_one_to_one, mutual_best
from molframe.plans.spatial import pairs_between
from molframe.session import cut


def ss_changes(a: DataFrame, b: DataFrame, alignment: DataFrame, keys: list[str], pos: str, none: str = "-") -> DataFrame:
    """Aligned pairs (i, j) whose codes differ, and coded residues of either side that the alignment skips."""
    x = a.select(*keys, F.col(pos).alias("i"), F.col("code").alias("kind_a"))
    y = b.select(*keys, F.col(pos).alias("j"), F.col("code").alias("kind_b"))
    left = alignment.select(*keys, "i", "j").join(x, [*keys, "i"], "full_outer")
    full = left.join(y, [*keys, "j"], "full_outer")
    ka, kb = F.coalesce("kind_a", F.lit(none)), F.coalesce("kind_b", F.lit(none))
    return full.filter(ka != kb).select(*keys, "i", "j", ka.alias("kind_a"), kb.alias("kind_b"))


def strand_pairings(bridges: DataFrame, strands: DataFrame, keys: list[str], least: int = 2, by: str | None = None) -> DataFrame:
    """Per strand pair: bridges, kind by majority and register (the low median of j - i parallel, i + j antiparallel).

    bridges: keys, i, j, kind; strands: keys, strand, first, last (residue places). `by` names a column of the bridges, such as the
    structure they are of, that is one more key: strands are then looked up once for all."""
    own, at = strands.select(*keys, "strand", "first", "last"), list(keys)
    keys = [*keys, *([by] if by else [])]
    p = points_in(bridges, own, at, "i", "first", "last").withColumnRenamed("strand", "a").drop("first", "last")
    p = points_in(p, own, at, "j", "first", "last").withColumnRenamed("strand", "b").drop("first", "last").filter("a <> b")
    turn = F.col("a") > F.col("b")
    p = p.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turn, F.col("j")).otherwise(F.col("i")).alias("i"),
                 F.when(turn, F.col("i")).otherwise(F.col("j")).alias("j"), "kind")
    key = [*keys, "a", "b"]
    # most strand pairs hold too few bridges: counts come first. The low median of two is the lesser; others are looked for where more are left
    e = p.groupBy(*key).agg(F.count(F.lit(1)).alias("bridges"), F.count_if(F.col("kind") == "P").alias("_p"), F.min(F.col("j") - F.col("i")).alias("_rp"), F.min(F.col("i") + F.col("j")).alias("_ra"))
    e = cut(e.filter(F.col("bridges") >= least))
    more = e.filter("bridges > 2")
    if not more.isEmpty():
        m = p.join(more.select(*key), key, "left_semi").groupBy(*key).agg(
            F.expr("percentile_disc(0.5) within group (order by j - i)").alias("_mp"), F.expr("percentile_disc(0.5) within group (order by i + j)").alias("_ma"))
        e = cut(e.join(m, key, "left").withColumn("_rp", F.coalesce("_mp", "_rp")).withColumn("_ra", F.coalesce("_ma", "_ra")))
    kind = F.when(F.col("_p") * 2 > F.col("bridges"), F.lit("P")).otherwise(F.lit("A"))
    e = e.withColumn("kind", kind)
    return e.select(*keys, "a", "b", "bridges", "kind", F.when(kind == "P", F.col("_rp")).otherwise(F.col("_ra")).cast("bigint").alias("register"))


def pairing_changes(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Strand pairings gained, lost, turned (other kind) or moved in register by k, of two `strand_pairings`."""
    x = a.select(*keys, "a", "b", F.col("kind").alias("kind_a"), F.col("register").alias("reg_a"))
    y = b.select(*keys, "a", "b", F.col("kind").alias("kind_b"), F.col("register").alias("reg_b"))
    j = x.join(y, [*keys, "a", "b"], "full_outer")
    status = (
        F.when(F.col("kind_a").isNull(), "gained").when(F.col("kind_b").isNull(), "lost").when(F.col("kind_a") != F.col("kind_b"), "kind")
        .when(F.col("reg_a") != F.col("reg_b"), "register")
    )
    shift = F.when(status == "register", F.col("reg_b") - F.col("reg_a"))
    return j.withColumn("status", status).withColumn("shift", shift).filter("status is not null").select(*keys, "a", "b", "status", "shift")


def same_place(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate pairs of places (keys, kind, id, first, last) that share at least half of the shorter one."""
    m = spans_meeting(x, y, [*keys, "kind"], "first", "last")
    short = F.least(F.col("last_a") - F.col("first_a"), F.col("last_b") - F.col("first_b")) + 1
    return m.filter(F.col("shared") * 2 >= short)


def pair_places(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one pairs of places of a kind: the largest overlap first, then the earliest in x, then in y."""
    c = same_place(x, y, keys)
    rank = [-F.col("shared"), F.col("first_a"), F.col("id_a"), F.col("first_b"), F.col("id_b")]
    return match_one_to_one(c, keys, "id_a", "id_b", rank)


def element_mates(a: DataFrame, b: DataFrame, alignment: DataFrame, keys: list[str]) -> DataFrame:
    """B's elements on A's numbering through the alignment (i, j), paired by place; a leftover helix of b that lies
    half inside a matched helix of a is a piece of it, the rest are extra."""
    from molframe.plans.intervals import points_in

    bj = points_in(alignment.select(*keys, "i", "j"), b.select(*keys, "id", "kind", "first", "last"), keys, "j", "first", "last")
    on_a = bj.groupBy(*keys, "id", "kind").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    pairs = pair_places(a.select(*keys, "kind", "id", "first", "last"), on_a, keys)
    mate = pairs.select(*keys, F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.lit("mate").alias("status"))
    left = on_a.join(mate.select(*keys, F.col("b").alias("id")), [*keys, "id"], "left_anti").filter("kind = 'H'")
    held = a.join(mate.select(*keys, F.col("a").alias("id")), [*keys, "id"], "left_semi").filter("kind = 'H'")
    m = spans_meeting(left, held.select(*keys, "kind", "id", "first", "last"), [*keys, "kind"], "first", "last")
    m = m.filter(F.col("shared") * 2 >= F.col("last_a") - F.col("first_a") + 1)
    piece = m.groupBy(*keys, F.col("id_a").alias("b")).agg(F.min(F.struct((-F.col("shared")).alias("k"), F.col("id_b").alias("a"))).alias("p"))
    piece = piece.select(*keys, F.col("p.a").alias("a"), "b", F.lit("piece").alias("status"))
    both = mate.unionByName(piece)
    rest_b = b.select(*keys, F.col("id").alias("b")).join(both.select(*keys, "b"), [*keys, "b"], "left_anti")
    rest_a = a.select(*keys, F.col("id").alias("a")).join(both.select(*keys, "a"), [*keys, "a"], "left_anti")
    out = both.unionByName(rest_b.withColumn("a", F.lit(None).cast("string")).withColumn("status", F.lit("extra")).select(*both.columns))
    return out.unionByName(rest_a.withColumn("b", F.lit(None).cast("string")).withColumn("status", F.lit("missing")).select(*both.columns))


def partner_by_place(a: DataFrame, b: DataFrame, most: float = 10.0, share: float = 0.5) -> DataFrame:
    """Names for b's chains by the a chain whose centre lies within 10 after the fit, sizes within a factor of two;
    each the other's best. a, b: entry, chain, idx, size, x, y, z (centres)."""
    ok = (F.least("size_a", "size_b") >= F.lit(share) * F.greatest("size_a", "size_b"))
    c = pairs_between(a, b, most, where=ok)
    m = mutual_best(c, ["entry"], "chain_a", "chain_b", [F.col("distance"), F.col("chain_a"), F.col("chain_b")])
    return m.select("entry", "chain_a", "chain_b", "distance")


def sheet_orders(a: DataFrame, b: DataFrame, mates: DataFrame, keys: list[str]) -> DataFrame:
    """Mated sheets whose mated strands stand in another order: not the same way along, nor reversed.

    a, b: keys, sheet, strand, position; mates: keys, a, b (strand ids)."""
    m = mates.join(a.select(*keys, F.col("strand").alias("a"), F.col("sheet").alias("sa"), F.col("position").alias("pa")), [*keys, "a"])
    m = m.join(b.select(*keys, F.col("strand").alias("b"), F.col("sheet").alias("sb"), F.col("position").alias("pb")), [*keys, "b"])
    w = Window.partitionBy(*keys, "sa", "sb").orderBy("pa")
    d = m.withColumn("_d", F.lead("pb").over(w) - F.col("pb"))
    g = d.groupBy(*keys, "sa", "sb").agg(F.count(F.lit(1)).alias("mated"), F.bool_and(F.coalesce(F.col("_d") > 0, F.lit(True))).alias("up"),
                                         F.bool_and(F.coalesce(F.col("_d") < 0, F.lit(True))).alias("down"))
    return g.filter("not (up or down)").select(*keys, "sa", "sb", "mated")
