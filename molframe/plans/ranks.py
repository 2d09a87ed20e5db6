"""Exact order statistics without one task per group.

The distinct values of a group are dealt to bins of nearly equal size, whose cut points come from a quantile sketch of the group
(merged map-side). A running count over the bins (few rows) says what lies before each bin, and values are ranked inside
their bin. Neither an outlier nor a value that most rows have makes a bin larger than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values of each group with how often they occur, combined map-side."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))


def attach(df: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    """`summary` (one row a group) beside every row; without groups it is one row and is broadcast."""
    if by:
        return df.join(summary, by)
    one = F.lit(1)
    return df.withColumn("_one", one).join(F.broadcast(summary.withColumn("_one", one)), "_one").drop("_one")


def binned(counts: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """`counts` (by, v, ...; a value once in a group) with _bin, growing with v: about a `bins`-th of the group's values in each.

    The cut points of a group (as many as it has values at most) are looked up in two steps, first among every k-th of them."""
    points = counts.groupBy(*by).agg(F.array_distinct(F.percentile_approx("v", [i / bins for i in range(1, bins)], 10 * bins)).alias("_cuts"))
    step = F.greatest(F.ceil(F.sqrt(F.size("_cuts"))).cast("int"), F.lit(1))
    points = points.withColumn("_step", step)
    points = points.withColumn("_coarse", F.transform(F.sequence(F.lit(0), F.size("_cuts") - 1, F.col("_step")), lambda i: F.get("_cuts", i)))
    d = attach(counts, points, by)
    low = lambda cuts: F.size(F.filter(cuts, lambda c: c <= F.col("v")))
    start = (low(F.col("_coarse")) - 1) * F.col("_step")
    place = F.when(start < 0, F.lit(0)).otherwise(start + low(F.slice("_cuts", F.greatest(start, F.lit(0)) + 1, F.col("_step"))))
    return d.withColumn("_bin", place.cast("bigint")).drop("_cuts", "_step", "_coarse")


def cumulative(counts: DataFrame, by: list[str], weight: list[str], bins: int = BINS) -> DataFrame:
    """`counts` (by, v, ...) with before_<w>: the sum of each weight over smaller values of the group, inside a bin and over the bins."""
    d = binned(counts, by, bins)
    inner = Window.partitionBy(*by, "_bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy(*by, "_bin").agg(*[F.sum(w).alias("_b_" + w) for w in weight])
    base = base.select(*by, "_bin", *[F.coalesce(F.sum("_b_" + w).over(outer), F.lit(0)).alias("_b_" + w) for w in weight])
    d = d.join(base, [*by, "_bin"])
    for w in weight:
        d = d.withColumn("before_" + w, F.coalesce(F.sum(w).over(inner), F.lit(0)) + F.col("_b_" + w))
    return d.drop("_bin", *["_b_" + w for w in weight])


def quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """n and the named quantiles (linear interpolation between the two ranks) of each group."""
    counts = cumulative(value_counts(df, by, value), by, ["c"])
    one = attach(counts, counts.groupBy(*by).agg(F.sum("c").alias("n")), by)
    held = lambda r: (F.col("before_c") <= r) & (r < F.col("before_c") + F.col("c"))
    aggs = []
    for name, q in qs.items():
        at = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        aggs += [
            F.max(F.when(held(lo), F.col("v"))).alias(name + "_lo"),
            F.max(F.when(held(hi), F.col("v"))).alias(name + "_hi"),
            F.first(at - lo).alias(name + "_f"),
        ]
    out = one.groupBy(*by, "n").agg(*aggs)
    mix = [(F.col(k + "_lo") + (F.col(k + "_hi") - F.col(k + "_lo")) * F.col(k + "_f")).alias(k) for k in qs]
    return out.select(*by, "n", *mix)


def auc(df: DataFrame, by: list[str], score: str, right: Column) -> DataFrame:
    """Chance that a right score exceeds a wrong one, ties half: one pass over the distinct scores."""
    d = df.filter(F.col(score).isNotNull() & right.isNotNull())
    counts = d.groupBy(*by, F.col(score).cast("double").alias("v")).agg(
        F.sum(right.cast("bigint")).alias("pos"), F.sum((~right).cast("bigint")).alias("neg")
    )
    c = cumulative(counts, by, ["neg"])
    won = F.col("pos") * (F.col("before_neg") + F.col("neg") / F.lit(2.0))
    out = c.groupBy(*by).agg(F.sum(won).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    area = F.col("won") / F.nullif((F.col("pos") * F.col("neg")).cast("double"), F.lit(0.0))
    return out.select(*by, F.col("pos").alias("n_right"), F.col("neg").alias("n_wrong"), area.alias("auc"))
