"""Published annotation on residues: domain segments, sequence features, structure lists, ranges in text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.plans.intervals import points_in


def segments_to_residues(segments: DataFrame, residues: DataFrame, keys: list[str]) -> DataFrame:
    """Each residue with the number of its domain, the last listed one where several hold it, -1 outside."""
    j = points_in(residues, segments.select(*keys, "domain", "first", "last"), keys, "seq", "first", "last", how="left")
    cols = [c for c in residues.columns]
    return j.groupBy(*cols).agg(F.coalesce(F.max("domain"), F.lit(-1)).alias("domain"))


def elements_in_segments(residues: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Elements with the domain that holds more than half of their residues."""
    size = residues.groupBy(*keys, "element").agg(F.count(F.lit(1)).alias("size"))
    held = points_in(residues, segments, keys, "seq", "first", "last").groupBy(*keys, "element", "domain").agg(F.count(F.lit(1)).alias("held"))
    return held.join(size, [*keys, "element"]).filter(F.col("held") * 2 > F.col("size"))


def features_to_residues(features: DataFrame, maps: DataFrame, residues: DataFrame, keys: list[str]) -> DataFrame:
    """Features (begin, end in database numbers) on residues through each chain segment's offset; a disulfide takes its
    two ends only. maps: keys, unp_first, seq_first, seq_last."""
    m = features.join(maps, keys).withColumn("_off", F.col("seq_first") - F.col("unp_first"))
    m = m.withColumn("lo", F.greatest(F.col("begin") + F.col("_off"), F.col("seq_first"))).withColumn("hi", F.least(F.col("end") + F.col("_off"), F.col("seq_last")))
    m = m.withColumn("at_lo", F.col("begin") + F.col("_off")).withColumn("at_hi", F.col("end") + F.col("_off")).filter("lo <= hi")
    span = m.select(*keys, "feature", "type", "lo", "hi", "at_lo", "at_hi")
    j = points_in(residues, span, keys, "seq", "lo", "hi")
    ends = (F.col("seq") == F.col("at_lo")) | (F.col("seq") == F.col("at_hi"))
    return j.filter((F.col("type") != "DISULFID") & (F.col("type") != "Disulfide bond") | ends).drop("lo", "hi", "at_lo", "at_hi")


def clip_features(features: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Regions cut to the track's positions; tracks: keys, first, last."""
    j = features.join(tracks, keys)
    j = j.withColumn("begin", F.greatest("begin", "first")).withColumn("end", F.least("end", "last"))
    return j.filter("begin <= end").drop("first", "last")


def best_structures(refs: DataFrame, keys: list[str], coverage: str, resolution: str, ident: str) -> DataFrame:
    """All structures of a key in order, as `rank`: the widest coverage first, then the finest resolution (unknown 99),
    then the id."""
    order = Window.partitionBy(*keys).orderBy(F.desc(coverage), F.coalesce(F.col(resolution), F.lit(99.0)), ident)
    return refs.withColumn("rank", F.row_number().over(order))


def segment_coverage(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Mean share of each segment (lo, hi) inside its slab (slab_lo, slab_hi)."""
    inside = F.greatest(F.lit(0), F.least("hi", "slab_hi") - F.greatest("lo", "slab_lo"))
    return segments.groupBy(*keys).agg(F.count(F.lit(1)).alias("segments"), F.avg(inside / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))).alias("mean"))


RANGE = re.compile(r"res:([^:]+):(-?\d+)([A-Za-z]?)(?:-(-?\d+)([A-Za-z]?))?")


def range_predicate(text: str, chain: Column | None = None) -> Column:
    """res:A:1-60 (or res:A:-5-100A) as a condition on chain, seq and icode."""
    m = RANGE.fullmatch(text)
    if m is None:
        raise ValueError(f"{text!r} is not a residue range like res:A:1-60")
    name, a, ia, b, ib = m.groups()
    lo, hi = (int(a), ia), (int(b), ib) if b is not None else (int(a), ia)
    place = F.struct(F.col("seq").cast("int").alias("s"), F.col("icode").alias("i"))
    at = lambda p: F.struct(F.lit(p[0]).alias("s"), F.lit(p[1]).alias("i"))
    return ((chain if chain is not None else F.col("chain")) == name) & (place >= at(lo)) & (place <= at(hi))


def deposited_names(places: DataFrame, keys: list[str]) -> DataFrame:
    """Element names from paired deposited helices (keys, element, name): plain numbers, names repeated in the entry
    and serial names say nothing and are left out."""
    number = F.col("name").rlike("^[0-9]+$") | F.col("name").rlike("^(HELX_P|H)?[0-9]+$")
    n = places.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("_n"))
    return places.join(n, [*keys, "name"]).filter((F.col("_n") == 1) & ~number).drop("_n")
