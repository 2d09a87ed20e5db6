"""Repeatable draws: the order of a pool is the order of a hash of its ids, the same on any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.plans.ordered import Ordered
from molframe.plans.ranks import attach


def seeded(seed: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def _ranked(df: DataFrame, by: list[str]) -> Ordered:
    """Rows in hash order. Hashes are even, so their first three digits cut every group into even blocks."""
    return Ordered(df, by, ["_h"], F.conv(F.substring("_h", 1, 3), 16, 10).cast("bigint"))


def bucketed_order(df: DataFrame, ident: str, seed: str, by: list[str] = ()) -> DataFrame:
    """`df` with its place (from 1) in the seeded order of its group."""
    d = df.withColumn("_h", seeded(seed, F.col(ident)))
    return _ranked(d, list(by)).row_number("place").done().drop("_h")


def hash_split(df: DataFrame, ident: str, seed: str, share: float) -> DataFrame:
    """The first round(share x n) ids in hash order are check, the rest tune."""
    p = bucketed_order(df, ident, seed)
    p = attach(p, df.agg(F.count(F.lit(1)).alias("_n")), [])
    return p.withColumn("part", F.when(F.col("place") <= F.floor(F.col("_n") * share + 0.5), "check").otherwise("tune")).drop("_n")


def stratified_draw(pool: DataFrame, ident: str, by: list[str], seed: str, k: int, accept: Column, reason: Column) -> DataFrame:
    """The first `k` accepted ids of each stratum and size bin in seeded order, and the ids refused before the last one
    taken, each with its reason. The order is walked until k are accepted or the stratum ends."""
    d = pool.withColumn("_h", seeded(seed, *[F.col(b) for b in by], F.col(ident))).withColumn("_ok", accept).withColumn("reason", reason)
    d = _ranked(d, by).row_number("place").running_sum(F.col("_ok").cast("bigint"), "_got").done()
    seen = (F.col("_got") < k) | (F.col("_ok") & (F.col("_got") == k))
    d = d.filter(seen).withColumn("taken", F.col("_ok")).withColumn("place", F.col("place").cast("int"))
    return d.select(*by, ident, "place", "taken", F.when(~F.col("_ok"), F.col("reason")).alias("reason"))


def largest_remainder(units: DataFrame, stratum: str, size: int) -> DataFrame:
    """Quota of each stratum in proportion to its units: floors, then the largest remainders, at least one each."""
    n = units.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    n = attach(n, n.agg(F.sum("n").alias("total")), [])
    share = F.lit(size) * F.col("n") / F.col("total")
    q = n.withColumn("_f", F.floor(share).cast("bigint")).withColumn("_r", share - F.floor(share))
    q = attach(q, q.agg((F.lit(size) - F.sum("_f")).alias("_left")), [])
    # strata are a short list by definition of a quota
    w = Window.orderBy(F.desc("_r"), stratum)
    q = q.withColumn("_k", F.row_number().over(w))
    quota = F.greatest(F.lit(1), F.col("_f") + F.when(F.col("_k") <= F.col("_left"), 1).otherwise(0))
    return q.select(stratum, "n", quota.cast("bigint").alias("quota"))


def draw_quota(units: DataFrame, unit: str, stratum: str, quotas: DataFrame, seed: str) -> DataFrame:
    """Units in seeded order up to their stratum's quota."""
    p = bucketed_order(units, unit, seed, [stratum])
    return p.join(quotas.select(stratum, "quota"), stratum).filter("place <= quota").drop("quota")


def group_holdout(entries: DataFrame, ident: str, group: str, seed: str, share: float = 1 / 3) -> DataFrame:
    """`entries` with `held`: whole groups in seeded order are taken until a third of the entries is held out."""
    g = entries.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", seeded(seed, F.col(group)))
    g = _ranked(g, []).running_sum(F.col("_n"), "_sum").done()
    total = entries.agg(F.floor(F.count(F.lit(1)) * F.lit(share) + 1e-9).alias("_want"))
    g = attach(g, total, []).select(group, ((F.col("_sum") - F.col("_n")) < F.col("_want")).alias("held"))
    return entries.join(g, group)


def exclude(pool: DataFrame, samples: DataFrame, ident: str) -> DataFrame:
    return pool.join(samples.select(ident).distinct(), ident, "left_anti")


def strata_shortfall(targets: DataFrame, drawn: DataFrame, stratum: str) -> DataFrame:
    """target, drawn, short per stratum."""
    n = drawn.groupBy(stratum).agg(F.count(F.lit(1)).alias("drawn"))
    out = targets.join(n, stratum, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)).cast("bigint"))
    return out.withColumn("short", F.greatest(F.col("target") - F.col("drawn"), F.lit(0)).cast("bigint"))


def pair_states(pool: DataFrame, accession: str, ident: str, kind: str, seed: str) -> DataFrame:
    """For each accession a seed (first in seeded order) with the next entry of another kind, and the pair's `place` in
    seeded order among the pairs of its two kinds; a caller with a quota keeps the first places."""
    d = pool.withColumn("_h", seeded(seed, F.col(ident)))
    first = F.struct("_h", F.col(ident).alias("i"), F.col(kind).alias("k"))
    head = d.groupBy(accession).agg(F.min(first).alias("_s")).select(accession, F.col("_s.i").alias("seed"), F.col("_s.k").alias("kind_a"))
    rest = d.join(head, accession).filter(F.col(kind) != F.col("kind_a"))
    one = rest.groupBy(accession, "seed", "kind_a").agg(F.min(first).alias("b"))
    one = one.select(accession, "seed", "kind_a", F.col("b.i").alias("partner"), F.col("b.k").alias("kind_b"))
    one = one.withColumn("_h", seeded(seed, F.col("seed")))
    ranked = _ranked(one, ["kind_a", "kind_b"]).row_number("place").done()
    return ranked.withColumn("place", F.col("place").cast("int")).drop("_h")


def homology_draw(domains: DataFrame, seed: str) -> DataFrame:
    """One chain per entry, then per cluster, then per superfamily, each the first in seeded order."""
    d = domains.withColumn("_h", seeded(seed, F.col("domain")))
    for k in ("entry", "cluster", "superfamily"):
        d = d.join(d.groupBy(k).agg(F.min("_h").alias("_h")), [k, "_h"], "left_semi")
    return d.drop("_h")


def level_pairs(drawn: DataFrame, level: int, seed: str) -> DataFrame:
    """Pairs of drawn domains that share exactly `level` levels of their dotted code: neighbours in seeded order inside
    the shared prefix, so a large superfamily gives as many pairs as it has members."""
    d = drawn.withColumn("_p", F.substring_index("superfamily", ".", level)).withColumn("_q", F.substring_index("superfamily", ".", level + 1))
    one = d.groupBy("_p", "_q").agg(F.min(F.struct(seeded(seed, F.col("domain")).alias("h"), "domain")).alias("b"))
    one = one.select("_p", "_q", F.col("b.domain").alias("domain"), F.col("b.h").alias("_h"))
    o = _ranked(one, ["_p"]).neighbour(["domain"], "prev_").done()
    return o.filter("prev_domain is not null").select(F.col("_p").alias("node"), F.col("prev_domain").alias("a"), F.col("domain").alias("b"))


def size_bin(n: Column) -> Column:
    return F.when(n < 300, "S").when(n < 1500, "M").when(n < 8000, "L").when(n < 30001, "XL").otherwise("XL+")


def release_window(date: Column, after: str, until: str) -> Column:
    return (date > F.lit(after).cast("date")) & (date <= F.lit(until).cast("date"))


def top_up(sample: DataFrame, rest: DataFrame, features: list[tuple[str, int]]) -> DataFrame:
    """`sample` with short feature quotas reached by swaps, feature by feature, as far as any swap is left; `fixed` rows stay.

    sample: id, stratum, bin, place (order of drawing), has (array of features), fixed; rest: id, stratum, bin, place, has, accepted ids
    only. A victim lacks the feature and holds no other feature that is at its target or short of it; the last drawn go first. The next
    of its pool that has the feature takes its row; pool rows before it are used up. A round swaps the k-th victim of each pool for
    the pool's k-th candidate, as many as the quota is short, and of these only as many as leave every other feature at its target: their
    running number is held against what the feature has to spare. The first always may, so a round without a swap is the end."""
    from molframe.session import cut

    names = [f for f, _ in features]
    s, r = cut(sample), cut(rest)
    pool = Window.partitionBy("stratum", "bin")
    for feature, target in features:
        others = [(f, t) for f, t in features if f != feature]
        while True:
            held = s.agg(*[F.count_if(F.array_contains("has", f)).alias(f"n{i}") for i, f in enumerate(names)]).first()
            count = {f: held[i] for i, f in enumerate(names)}
            need = target - count[feature]
            if need <= 0:
                break
            free = ~F.array_contains("has", feature) & ~F.col("fixed")
            for f, t in others:
                if count[f] <= t:
                    free = free & ~F.array_contains("has", f)
            out = s.filter(free).withColumn("_k", F.row_number().over(pool.orderBy(F.desc("place"), "id")))
            new = r.filter(F.array_contains("has", feature)).withColumn("_k", F.row_number().over(pool.orderBy("place", "id")))
            old = out.select("stratum", "bin", "_k", F.col("id").alias("gone"), F.col("place").alias("_at"), F.col("has").alias("_had"))
            swap = old.join(new.select("stratum", "bin", "_k", "id", F.col("place").alias("_from"), "has"), ["stratum", "bin", "_k"])
            # `need` rows at most: one after the other, as far as the others' surplus goes
            swap = cut(swap.orderBy("_k", "stratum", F.desc("_at"), "gone").limit(need))
            line = Window.orderBy("_k", "stratum", F.desc("_at"), "gone").rowsBetween(Window.unboundedPreceding, 0)
            ok = F.lit(True)
            for f, t in others:
                lost = F.sum((F.array_contains("_had", f) & ~F.array_contains("has", f)).cast("int")).over(line)
                ok = ok & ((lost <= max(count[f] - t, 0)) | ~F.array_contains("_had", f))
            swap = cut(swap.withColumn("_ok", ok).filter("_ok"))
            if swap.isEmpty():
                break
            place = swap.select(F.col("gone").alias("id"), F.col("id").alias("_new"), F.col("has").alias("_has"))
            j = s.join(place, "id", "left")
            s = cut(j.select(*[F.coalesce("_new", "id").alias(c) if c == "id" else F.when(F.col("_new").isNotNull(), F.col("_has")).otherwise(F.col("has")).alias(c) if c == "has" else F.col(c) for c in s.columns]))
            used = swap.groupBy("stratum", "bin").agg(F.max("_from").alias("_used"))
            r = cut(r.join(used, ["stratum", "bin"], "left").filter("_used is null or place > _used").drop("_used"))
    return s
