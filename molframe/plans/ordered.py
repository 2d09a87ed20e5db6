"""Ordered work along long chains without one task per chain.

A window over (key) puts all rows of a key in one task, so a key with a third of the rows would stall the job. Here
every ordered step runs in two levels: a window inside each (key, block), where `block` is a coarse value that grows
with the order (line number div 4096, hour of a time), and a window over the per-block summaries, which are fewer by
the block size. The row-level shuffle is by (key, block) and is shared by all steps on one frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def block_of(position: Column, size: int = BLOCK) -> Column:
    return F.floor(position / F.lit(size)).cast("bigint")


class Ordered:
    """`df` seen as ordered chains: `keys` name the chain, `order` is a total order in it, `block` grows with it."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], block: Column):
        self.keys, self.order = list(keys), list(order)
        self.df = df.withColumn("_blk", block)
        self.inner = Window.partitionBy(*self.keys, "_blk").orderBy(*self.order)
        self.outer = Window.partitionBy(*self.keys).orderBy("_blk")

    def _with(self, df: DataFrame) -> "Ordered":
        new = object.__new__(Ordered)
        new.keys, new.order, new.inner, new.outer, new.df = self.keys, self.order, self.inner, self.outer, df
        return new

    def done(self) -> DataFrame:
        return self.df.drop("_blk")

    def with_column(self, name: str, value: Column) -> "Ordered":
        return self._with(self.df.withColumn(name, value))

    def _join_blocks(self, df: DataFrame, blocks: DataFrame) -> DataFrame:
        return df.join(blocks, [*self.keys, "_blk"], "left")

    def neighbour(self, cols: list[str], prefix: str, ahead: bool = False) -> "Ordered":
        """The named columns of the row before (or after), null at the ends, as <prefix><name>."""
        row = F.struct(*cols)
        side = F.lead if ahead else F.lag
        edge = F.min_by if ahead else F.max_by
        place = F.struct(*self.order)
        blocks = self.df.groupBy(*self.keys, "_blk").agg(edge(row, place).alias("_edge"))
        blocks = blocks.withColumn("_edge", side("_edge").over(self.outer))
        df = self.df.withColumn("_near", side(row).over(self.inner))
        df = self._join_blocks(df, blocks)
        near = F.coalesce(F.col("_near"), F.col("_edge"))
        keep = df.columns[:]
        keep = [c for c in keep if c not in ("_near", "_edge")]
        return self._with(df.select(*keep, *[near[c].alias(prefix + c) for c in cols]))

    def running_sum(self, value: Column, name: str) -> "Ordered":
        """Sum of `value` up to and with each row."""
        df = self.df.withColumn("_v", value)
        blocks = df.groupBy(*self.keys, "_blk").agg(F.sum("_v").alias("_base"))
        before = self.outer.rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn("_base", F.coalesce(F.sum("_base").over(before), F.lit(0)))
        df = df.withColumn("_s", F.sum("_v").over(self.inner.rowsBetween(Window.unboundedPreceding, 0)))
        df = self._join_blocks(df, blocks)
        return self._with(df.withColumn(name, F.col("_s") + F.col("_base")).drop("_v", "_s", "_base"))

    def running_sums(self, values: dict[str, Column]) -> "Ordered":
        """Several running sums in one pass, each up to and with its row, under the names given."""
        df = self.df.withColumns({f"_v_{k}": v for k, v in values.items()})
        before = self.outer.rowsBetween(Window.unboundedPreceding, -1)
        blocks = df.groupBy(*self.keys, "_blk").agg(*[F.sum(f"_v_{k}").alias(f"_b_{k}") for k in values])
        blocks = blocks.select(*self.keys, "_blk", *[F.coalesce(F.sum(f"_b_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in values])
        inner = self.inner.rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({f"_s_{k}": F.sum(f"_v_{k}").over(inner) for k in values})
        df = self._join_blocks(df, blocks).withColumns({k: F.col(f"_s_{k}") + F.col(f"_b_{k}") for k in values})
        return self._with(df.drop(*[p + k for k in values for p in ("_v_", "_s_", "_b_")]))

    def row_number(self, name: str) -> "Ordered":
        return self.running_sum(F.lit(1).cast("bigint"), name)

    def carry(self, value: Column, name: str, ahead: bool = False) -> "Ordered":
        """Last non-null `value` at or before each row (first at or after when `ahead`)."""
        pick = F.first if ahead else F.last
        frame = (0, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, 0)
        past = (1, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, -1)
        edge = F.min_by if ahead else F.max_by
        df = self.df.withColumn("_v", value)
        known = df.filter(F.col("_v").isNotNull())
        known = known.groupBy(*self.keys, "_blk").agg(edge("_v", F.struct(*self.order)).alias("_edge"))
        every = df.groupBy(*self.keys, "_blk").agg(F.lit(1).alias("_one"))
        blocks = every.join(known, [*self.keys, "_blk"], "left").drop("_one")
        blocks = blocks.withColumn("_edge", pick("_edge", ignorenulls=True).over(self.outer.rowsBetween(*past)))
        df = df.withColumn("_s", pick("_v", ignorenulls=True).over(self.inner.rowsBetween(*frame)))
        df = self._join_blocks(df, blocks)
        return self._with(df.withColumn(name, F.coalesce("_s", "_edge")).drop("_v", "_s", "_edge"))

    def islands(self, starts: Column, name: str) -> "Ordered":
        """Number of the island each row is in, from 1; `starts` says which rows open one."""
        return self.running_sum(F.when(starts, F.lit(1)).otherwise(F.lit(0)).cast("bigint"), name)


def runs(df: DataFrame, keys: list[str], order: list[str], block: Column, code: str,
         broken: Column | None = None) -> DataFrame:
    """Every row with the number of its maximal run of one code; `broken` rows open a run of their own."""
    o = Ordered(df, keys, order, block).neighbour([code], "prev_")
    starts = F.col("prev_" + code).isNull() | (F.col("prev_" + code) != F.col(code))
    if broken is not None:
        starts = starts | F.coalesce(broken, F.lit(False))
    return o.islands(starts, "run").done().drop("prev_" + code)
