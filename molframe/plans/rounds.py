"""Sequential greedy rules as rounds of joins.

In a sequential rule an item is taken when it clashes with none taken before it. An item whose every better rival is
already settled can be settled at once, so each round settles all such items of all groups together and the result is
that of the sequential rule. Lineage is cut once a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.session import cut


def match_one_to_one(cand: DataFrame, group: list[str], a: str, b: str, rank: list[Column]) -> DataFrame:
    """Pairs of `cand` taken best first, each `a` and each `b` of a group at most once.

    `rank` must order the candidates of one a or one b without ties. Every round takes the pairs that are best for
    both their ends; the best pair left is always one of them, so the loop ends."""
    left = cut(cand.withColumn("_rank", F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)])))
    taken: DataFrame | None = None
    while True:
        best_a = left.groupBy(*group, a).agg(F.min("_rank").alias("_ra"))
        best_b = left.groupBy(*group, b).agg(F.min("_rank").alias("_rb"))
        now = left.join(best_a, [*group, a]).join(best_b, [*group, b])
        now = now.filter((F.col("_rank") == F.col("_ra")) & (F.col("_rank") == F.col("_rb"))).drop("_ra", "_rb")
        now = cut(now)
        taken = now if taken is None else taken.unionByName(now)
        left = left.join(now.select(*group, a), [*group, a], "left_anti")
        left = cut(left.join(now.select(*group, b), [*group, b], "left_anti"))
        if left.isEmpty():
            return taken.drop("_rank")


def mutual_best(cand: DataFrame, group: list[str], a: str, b: str, rank: list[Column]) -> DataFrame:
    """Pairs that are the best of both their ends, in one pass (no second choice)."""
    c = cand.withColumn("_rank", F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)]))
    best = lambda k: c.groupBy(*group, k).agg(F.min("_rank").alias("_rank"))
    out = c.join(best(a), [*group, a, "_rank"], "left_semi").join(best(b), [*group, b, "_rank"], "left_semi")
    return out.drop("_rank")


def keep_unless_beaten(items: DataFrame, clashes: DataFrame, ident: list[str]) -> DataFrame:
    """Items with `kept`: an item is kept when no kept better item clashes with it.

    `clashes` has one row per (worse, better) pair, the worse one's `ident` and the better one's under _by."""
    by = [c + "_by" for c in ident]
    state = cut(items.select(*ident).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        b = state.select(*[F.col(c).alias(c + "_by") for c in ident], F.col("kept").alias("_k"))
        seen = clashes.join(b, by).groupBy(*ident).agg(
            F.max(F.coalesce(F.col("_k"), F.lit(False)).cast("int")).alias("_hit"),
            F.max(F.col("_k").isNull().cast("int")).alias("_open"),
        )
        new = state.join(seen, ident, "left")
        verdict = F.when(F.coalesce("_hit", F.lit(0)) == 1, F.lit(False)).when(F.coalesce("_open", F.lit(0)) == 0, F.lit(True))
        state = cut(new.select(*ident, F.coalesce("kept", verdict).alias("kept")))
        if state.filter(F.col("kept").isNull()).isEmpty():
            return items.join(state, ident)


def lowest_free_level(items: DataFrame, clashes: DataFrame, ident: list[str]) -> DataFrame:
    """Items with `level`: the lowest not used by a better clashing item, settled in rounds."""
    by = [c + "_by" for c in ident]
    clashes = cut(clashes)
    # only items with a better rival wait for others; every other one has level 0 and takes part in no round
    worse = cut(clashes.select(*ident).distinct())
    better = clashes.select(*[F.col(c).alias(c[:-3]) for c in by]).distinct()
    first = better.join(worse, ident, "left_anti").withColumn("level", F.lit(0))
    state = cut(worse.withColumn("level", F.lit(None).cast("int")).unionByName(first))
    while not state.filter(F.col("level").isNull()).isEmpty():
        b = state.select(*[F.col(c).alias(c + "_by") for c in ident], F.col("level").alias("_l"))
        seen = clashes.join(b, by).groupBy(*ident).agg(
            F.collect_set("_l").alias("_used"), F.max(F.col("_l").isNull().cast("int")).alias("_open")
        )
        new = state.join(seen, ident, "left")
        used = F.coalesce("_used", F.array().cast("array<int>"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(used)), used))
        ready = F.coalesce("_open", F.lit(0)) == 0
        state = cut(new.select(*ident, F.coalesce("level", F.when(ready, free)).cast("int").alias("level")))
    return items.join(state, ident, "left").withColumn("level", F.coalesce("level", F.lit(0)))


def first_by(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, name: str = "rank") -> DataFrame:
    """The first `k` rows of each key. Spark trims every map task to `k` rows a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
