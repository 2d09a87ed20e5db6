"""Interval joins keyed by bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 64


def _bucket(c: str, size: int) -> Column:
    return F.floor(F.col(c) / F.lit(size)).cast("bigint")


def points_in(points: DataFrame, spans: DataFrame, keys: list[str], pos: str, first: str, last: str,
              size: int = BUCKET, how: str = "inner") -> DataFrame:
    """Points joined to the spans of their key that hold them. A point is in one bucket, so no pair comes twice."""
    extra = [c for c in spans.columns if c not in keys]
    s = spans.select(
        *[F.col(k).alias("_k" + k) for k in keys], *[F.col(c).alias("_s" + c) for c in extra],
        F.explode(F.sequence(_bucket(first, size), _bucket(last, size))).alias("_sb"),
    )
    cond = (F.col("_pb") == F.col("_sb")) & (F.col(pos) >= F.col("_s" + first)) & (F.col(pos) <= F.col("_s" + last))
    for k in keys:
        cond = cond & (F.col(k) == F.col("_k" + k))
    joined = points.withColumn("_pb", _bucket(pos, size)).join(s, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_pb")
    return joined.select(*[F.col(c) for c in points.columns], *[F.col("_s" + c).alias(c) for c in extra if c not in points.columns])


def spans_meeting(a: DataFrame, b: DataFrame, keys: list[str], first: str, last: str,
                  size: int = BUCKET) -> DataFrame:
    """Pairs of spans of one key that share a place; kept in the bucket of the later start, so once."""
    tag = lambda d, t: d.select(
        *keys, *[F.col(c).alias(c + t) for c in d.columns if c not in keys],
        F.explode(F.sequence(_bucket(first, size), _bucket(last, size))).alias("_b"),
    )
    j = tag(a, "_a").join(tag(b, "_b"), [*keys, "_b"])
    start = F.greatest(F.col(first + "_a"), F.col(first + "_b"))
    end = F.least(F.col(last + "_a"), F.col(last + "_b"))
    return j.withColumn("shared", end - start + 1).filter(
        (F.col("shared") > 0) & (F.col("_b") == F.floor(start / F.lit(size)))
    ).drop("_b")
