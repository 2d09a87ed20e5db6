"""Statistics of a campaign: outcomes, scores, agreement between two codes, calibration, run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.functions.geom import snap
from molframe.functions.linalg import assign_kxk
from molframe.functions.stats import wilson
from molframe.functions.text import letters
from molframe.plans.ordered import Ordered, block_of
from molframe.plans.ranks import attach, cumulative, quantiles, value_counts

OUTCOMES = ["pass", "fail", "not judged", "does not apply"]


# ---------------------------------------------------------------- outcomes
def outcome(passed: Column, applies: Column) -> Column:
    return F.when(~applies, F.lit("does not apply")).when(passed.isNull(), F.lit("not judged")).when(passed, F.lit("pass")).otherwise(F.lit("fail"))


def outcome_counts(rows: DataFrame) -> DataFrame:
    """(entry, stratum, criterion, outcome) -> counts of each outcome per criterion, per stratum and over all: one
    pass with grouping sets. A total has null where it is not grouped."""
    g = rows.groupingSets([["criterion"], ["stratum"], []], "criterion", "stratum")
    names = {o: o.replace(" ", "_") for o in OUTCOMES}
    return g.agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in names.items()], F.grouping_id().alias("level"))


def entry_passes(rows: DataFrame) -> DataFrame:
    """An entry passes when none of its criteria fails; counted per stratum."""
    e = rows.groupBy("entry", "stratum").agg(F.count_if(F.col("outcome") == "fail").alias("fails"))
    return e.groupBy("stratum").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("fails") == 0).alias("passing"))


def count_check(views: DataFrame, keys: list[str], view: str, value: str, limit: float) -> DataFrame:
    """Passes when every view's count is at most `limit`; a missing or non-finite one fails. `where` names all such views
    in order."""
    v = F.col(value)
    inf = F.lit(float("inf"))
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == inf) | (v > limit)
    flagged = views.withColumn("_bad", bad)
    named = flagged.filter("_bad").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.col(view))), ", ").alias("where"))
    out = flagged.groupBy(*keys).agg(F.count_if("_bad").alias("bad"), F.count(F.lit(1)).alias("views"))
    return out.join(named, keys, "left").select(*keys, "views", "bad", (F.col("bad") == 0).alias("passes"), F.coalesce("where", F.lit("")).alias("where"))


def named_totals(rows: DataFrame, name: str, entry: str, times: str, first_view: Column) -> DataFrame:
    """Per name: entries that had it, times in the first view, times over all views."""
    return rows.groupBy(name).agg(
        F.countDistinct(entry).alias("entries"), F.sum(F.when(first_view, F.col(times)).otherwise(0)).alias("first_view"), F.sum(times).alias("all_views")
    )


def campaign_totals(rows: DataFrame) -> DataFrame:
    """Per half and stratum, per half, and over all: drawn, refused, errors, failed."""
    s = F.col("status")
    g = rows.groupingSets([["half", "stratum"], ["half"], []], "half", "stratum")
    return g.agg(F.count(F.lit(1)).alias("entries"), *[F.count_if(s == k).alias(k) for k in ("drawn", "refused", "error", "failed")])


def entry_summary(entries: DataFrame, parts: dict[str, DataFrame], key: str = "entry") -> DataFrame:
    """One row per entry with how many rows each part has for it."""
    out = entries.select(key).distinct()
    for name, df in parts.items():
        out = out.join(df.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left")
    return out.fillna(0, list(parts))


def mean_scores(scores: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(n) for n in names])


def below_targets(scores: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Chains under a target, with which."""
    miss = F.array_compact(F.array(*[F.when(F.col(k) < t, F.lit(k)) for k, t in targets.items()]))
    return scores.withColumn("under", F.array_join(miss, ", ")).filter("under <> ''")


# ---------------------------------------------------------------- calibration
def calibration(splits: DataFrame, by: list[str], confidence: str, right: Column, edges: list[float]) -> DataFrame:
    """Right of all per confidence bin, with the 95 % interval. The last bin holds its upper edge."""
    c = F.col(confidence)
    b = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        top = (c <= edges[k + 1]) if k == len(edges) - 2 else (c < edges[k + 1])
        b = F.when((c >= edges[k]) & top, F.lit(k)).otherwise(b)
    g = splits.withColumn("bin", b).filter("bin is not null").groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(right).alias("k")
    )
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.select(*by, "bin", "n", "k", lo.alias("low"), hi.alias("high"))


def threshold_sweep(scores: DataFrame, by: list[str], score: str, grid: list[float]) -> DataFrame:
    """Per threshold of a small fixed grid: how many scores reach it and their mean."""
    t = scores.withColumn("threshold", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    ok = F.col(score) >= F.col("threshold")
    return t.groupBy(*by, "threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("meeting"), F.avg(F.when(ok, F.col(score))).alias("mean"))


def largest_safe(sweep: DataFrame, fell: Column) -> DataFrame:
    """The largest threshold at which nothing fell."""
    return sweep.groupBy("threshold").agg(F.max(fell.cast("int")).alias("_f")).filter("_f = 0").agg(F.max("threshold").alias("threshold"))


def quantile_interval(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """The quantile with a distribution-free 95 % interval: order statistics at the Wilson ranks."""
    counts = cumulative(value_counts(df, by, value), by, ["c"])
    c = attach(counts, counts.groupBy(*by).agg(F.sum("c").alias("n")), by)
    n = F.col("n")
    lo, hi = wilson(F.lit(q) * n, n)
    a = F.greatest(F.lit(1), F.floor(n * lo))
    b = F.least(n, F.ceil(n * hi))
    held = lambda rank: (F.col("before_c") < rank) & (rank <= F.col("before_c") + F.col("c"))
    ci = c.groupBy(*by).agg(F.max(F.when(held(a), F.col("v"))).alias("low"), F.max(F.when(held(b), F.col("v"))).alias("high"))
    return quantiles(df, by, value, {"value": q}).join(ci, by)


def binned_histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts on [lo, hi) bins and one bin of values at the top edge or past it."""
    v = F.col(value)
    b = F.when(v >= edges[-1], F.lit(len(edges) - 1))
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        b = b.when((v >= lo) & (v < hi), F.lit(k))
    return df.withColumn("bin", b).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("entries"))


def option_effects(tried: DataFrame) -> DataFrame:
    """Per option: tried, brought above the floor, median seconds and size."""
    g = tried.groupBy("option").agg(F.count(F.lit(1)).alias("tried"), F.count_if("above").alias("brought_above"))
    for c in ("seconds", "size"):
        g = g.join(quantiles(tried, ["option"], c, {"median_" + c: 0.5}).drop("n"), "option")
    return g


# ---------------------------------------------------------------- agreement of two annotations
def code_agreement(a: DataFrame, b: DataFrame, keys: list[str], pos: str, skip: DataFrame | None = None, reach: int = 4) -> DataFrame:
    """Share of places with equal codes, and places in one only. Places within `reach` of a skipped one do not count."""
    x = a.select(*keys, pos, F.col("code").alias("code_a"))
    y = b.select(*keys, pos, F.col("code").alias("code_b"))
    if skip is not None:
        near = skip.select(*keys, F.explode(F.sequence(F.col(pos) - reach, F.col(pos) + reach)).alias(pos)).distinct()
        x, y = x.join(near, [*keys, pos], "left_anti"), y.join(near, [*keys, pos], "left_anti")
    j = x.join(y, [*keys, pos], "full_outer")
    both = F.col("code_a").isNotNull() & F.col("code_b").isNotNull()
    g = j.groupBy(*keys).agg(
        F.count_if(both).alias("compared"), F.count_if(both & (F.col("code_a") == F.col("code_b"))).alias("equal"),
        F.count_if(F.col("code_b").isNull()).alias("only_a"), F.count_if(F.col("code_a").isNull()).alias("only_b"),
    )
    return g.withColumn("share", F.col("equal") / F.nullif(F.col("compared"), F.lit(0)))


def alignment_agreement(ref: DataFrame, got: DataFrame, keys: list[str], slack: int) -> DataFrame:
    """Share of reference pairs (i, j) whose i is given a j within `slack`."""
    j = ref.join(got.select(*keys, "i", F.col("j").alias("j2")), [*keys, "i"], "left")
    hit = F.coalesce(F.abs(F.col("j") - F.col("j2")) <= slack, F.lit(False))
    g = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(hit).alias("reproduced"))
    return g.withColumn("share", F.col("reproduced") / F.col("pairs"))


def alignment_departures(ref: DataFrame, got: DataFrame, keys: list[str], slack: int) -> DataFrame:
    """Runs of reference pairs that are not reproduced: first and last i, how many, and the shift of the first."""
    j = ref.join(got.select(*keys, "i", F.col("j").alias("j2")), [*keys, "i"], "left")
    hit = F.coalesce(F.abs(F.col("j") - F.col("j2")) <= slack, F.lit(False))
    o = Ordered(j.withColumn("_hit", hit), keys, ["i"], block_of(F.col("i"))).neighbour(["_hit"], "prev_")
    o = o.islands(F.col("prev__hit").isNull() | (F.col("prev__hit") != F.col("_hit")), "_run").done().filter("not _hit")
    return o.groupBy(*keys, "_run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("pairs"),
                                        F.min_by(F.col("j2") - F.col("j"), "i").alias("shift")).drop("_run")


def pair_set_scores(got: DataFrame, ref: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of unordered pairs (a, b)."""
    norm = lambda d: d.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    j = norm(got).withColumn("g", F.lit(1)).join(norm(ref).withColumn("r", F.lit(1)), [*keys, "a", "b"], "full_outer")
    c = j.groupBy(*keys).agg(F.count("g").alias("n_got"), F.count("r").alias("n_ref"), F.count_if(F.col("g").isNotNull() & F.col("r").isNotNull()).alias("shared"))
    p = F.col("shared") / F.nullif(F.col("n_got"), F.lit(0))
    r = F.col("shared") / F.nullif(F.col("n_ref"), F.lit(0))
    return c.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.lit(2.0) * F.col("shared") / (F.col("n_got") + F.col("n_ref")))


def stem_recall(got: DataFrame, ref: DataFrame, keys: list[str], share: float = 2 / 3) -> DataFrame:
    """Reference stems matched one to one to found stems by most shared pairs; recalled at two thirds of theirs.
    got, ref: keys, stem, a, b."""
    from molframe.plans.rounds import match_one_to_one

    norm = lambda d, n: d.select(*keys, F.col("stem").alias(n), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    both = norm(ref, "ref").join(norm(got, "got"), [*keys, "a", "b"]).groupBy(*keys, "ref", "got").agg(F.count(F.lit(1)).alias("shared"))
    m = match_one_to_one(both, keys, "ref", "got", [-F.col("shared"), F.col("ref"), F.col("got")])
    size = ref.groupBy(*keys, F.col("stem").alias("ref")).agg(F.count(F.lit(1)).alias("pairs"))
    out = size.join(m.drop("got"), [*keys, "ref"], "left")
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("stems"), F.count_if(F.col("shared") >= F.col("pairs") * share).alias("recalled"))


def contact_report(found: DataFrame, claimed: DataFrame, keys: list[str], drawn: DataFrame | None = None) -> DataFrame:
    """Every contact found or claimed with its status: verified, false, or missing (and why)."""
    j = found.select(*keys).distinct().withColumn("f", F.lit(1)).join(claimed.select(*keys).distinct().withColumn("c", F.lit(1)), keys, "full_outer")
    if drawn is not None:
        j = j.join(drawn.select(*keys).distinct().withColumn("d", F.lit(1)), keys, "left")
    else:
        j = j.withColumn("d", F.lit(1))
    status = F.when(F.col("f").isNotNull() & F.col("c").isNotNull(), "verified").when(F.col("f").isNull(), "false").when(
        F.col("d").isNull(), "missing: not drawn"
    ).otherwise("missing")
    return j.select(*keys, status.alias("status"))


def label_overlap(residues: DataFrame, keys: list[str]) -> DataFrame:
    """Share of judged residues (`ref` not null) in the best one-to-one matching of `ref` and `auto` labels.

    The counts are aggregated first; the assignment sees one small k x k table per chain, k the number of domains."""
    c = residues.filter("ref is not null").groupBy(*keys, "ref", "auto").agg(F.count(F.lit(1)).alias("n"))
    dr, da = c.select(*keys, "ref").distinct(), c.select(*keys, "auto").distinct()
    rw, aw = Window.partitionBy(*keys).orderBy("ref"), Window.partitionBy(*keys).orderBy("auto")
    c = c.join(dr.withColumn("i", F.row_number().over(rw) - 1), [*keys, "ref"]).join(da.withColumn("k", F.row_number().over(aw) - 1), [*keys, "auto"])
    size = c.groupBy(*keys).agg((F.max("i") + 1).alias("rows"), (F.max("k") + 1).alias("cols"), F.sum("n").alias("judged"),
                                F.map_from_entries(F.collect_list(F.struct(F.struct("i", "k"), F.col("n").cast("double")))).alias("m"))
    cell = lambda i, k: F.coalesce(F.try_element_at("m", F.struct(i.cast("int").alias("i"), k.cast("int").alias("k"))), F.lit(0.0))
    seq = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    flat = F.flatten(F.transform(seq("rows"), lambda i: F.transform(seq("cols"), lambda k: cell(i, k))))
    s = size.withColumn("w", flat).select(*keys, "judged", "m", F.posexplode(assign_kxk("w", F.col("rows"))).alias("i", "p"))
    got = F.when(F.col("p") >= 0, cell(F.col("i"), F.col("p"))).otherwise(F.lit(0.0))
    g = s.groupBy(*keys, "judged").agg(F.sum(got).cast("bigint").alias("matched"))
    return g.withColumn("overlap", F.col("matched") / F.col("judged"))


# ---------------------------------------------------------------- pools and formulas
def pool_record(ids: DataFrame, by: list[str], ident: str) -> DataFrame:
    """Count and digest of a pool: the SHA-256 of the newline-joined block digests, a block being the sorted ids that
    share the first two characters of their own hash. The digest does not depend on order and no task holds the pool."""
    d = ids.select(*by, F.col(ident).cast("string").alias("id")).distinct().withColumn("_b", F.substring(F.sha2("id", 256), 1, 3))
    block = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("h"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "h"))), lambda x: x["h"]), "\n")
    return block.groupBy(*by).agg(F.sum("n").alias("n"), F.sha2(rows, 256).alias("digest"))


def stoichiometry(copies: DataFrame, by: list[str], group: str) -> DataFrame:
    """Formula such as A2B2: groups of copies by number, the largest first, lettered by rank."""
    n = copies.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), group)
    r = n.withColumn("rank", F.row_number().over(w))
    part = F.concat(letters(F.col("rank") - 1), F.when(F.col("n") > 1, F.col("n").cast("string")).otherwise(F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("rank", part.alias("t"))))
    return r.groupBy(*by).agg(F.array_join(F.transform(rows, lambda x: x["t"]), "").alias("formula"), F.count(F.lit(1)).alias("groups"))


def entry_features(atoms: DataFrame, heavy: int = 6) -> DataFrame:
    """Per entry: models, chains, residues, protein and nucleic residues, molecules of at least `heavy` atoms, CA-only."""
    from molframe.functions import chemistry as chem

    kind = chem.polymer_kind(F.col("resname"))
    res = atoms.groupBy("entry", "chain", "seq", "icode", "resname").agg(
        F.count_if(~F.col("elem").isin("H", "D")).alias("atoms"), F.max((F.col("atom") == "CA").cast("int")).alias("ca")
    ).withColumn("kind", kind)
    water = F.col("resname").isin(chem.WATER)
    glycan = F.col("resname").isin(chem.SUGARS)
    prot = F.col("kind") == "protein"
    return res.groupBy("entry").agg(
        F.countDistinct("chain").alias("chains"), F.count_if(prot).alias("protein"), F.count_if(F.col("kind") == "nucleic").alias("nucleic"),
        F.count_if(F.col("kind").isNull() & ~water & (F.col("atoms") >= heavy)).alias("ligands"), F.count_if(glycan).alias("sugars"),
        F.coalesce(F.bool_and(F.when(prot, F.col("atoms") == 1)), F.lit(False)).alias("ca_only"),
    )


# ---------------------------------------------------------------- runs compared
def gained_lost(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows only in b (gained) or only in a (lost)."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    y = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, keys, "full_outer").filter("_a is null or _b is null")
    return j.select(*keys, F.when(F.col("_a").isNull(), F.lit("gained")).otherwise(F.lit("lost")).alias("status"))


def moved(base: DataFrame, run: DataFrame) -> DataFrame:
    """Everything that differs between two runs (entry, pass, failing array, count, area), one row each."""
    tag = lambda d, t: d.select("entry", *[F.col(c).alias(c + t) for c in ("pass", "failing", "count", "area")], F.lit(1).alias("in" + t))
    j = tag(base, "_a").join(tag(run, "_b"), "entry", "full_outer")
    one = F.col("in_a").isNull() | F.col("in_b").isNull()
    row = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    fails = lambda x, y, what: F.transform(F.array_sort(F.array_except(x, y)), lambda k: row(what, k))
    text = lambda c: F.col(c).cast("string")
    arrow = lambda c: F.concat(text(c + "_a"), F.lit(" -> "), text(c + "_b"))
    single = lambda cond, what, name: F.when(cond, F.array(row(what, name))).otherwise(F.array().cast("array<struct<what:string,name:string>>"))
    changes = F.concat(
        single(F.col("pass_a") != F.col("pass_b"), "pass", arrow("pass")), fails(F.col("failing_b"), F.col("failing_a"), "now fails"),
        fails(F.col("failing_a"), F.col("failing_b"), "now passes"), single(~F.col("count_a").eqNullSafe(F.col("count_b")), "count", arrow("count")),
        single(~F.col("area_a").eqNullSafe(F.col("area_b")), "area", arrow("area")),
    )
    every = F.when(one, F.array(row("in one run only", F.when(F.col("in_a").isNull(), F.lit("b")).otherwise(F.lit("a"))))).otherwise(changes)
    return j.select("entry", F.explode(every).alias("c")).select("entry", "c.what", "c.name")


def judge_run(base: DataFrame, run: DataFrame, changes: DataFrame, fragile: int = 3) -> DataFrame:
    """fragile (passes moved by `fragile` or a criterion that never failed now does), sensitive, or stable."""
    fail = lambda d, t: d.select(F.explode("failing").alias("k")).distinct().withColumn(t, F.lit(1))
    new = fail(run, "b").join(fail(base, "a"), "k", "left_anti").agg(F.count(F.lit(1)).alias("new_failing"))
    passed = lambda d, n: d.agg(F.count_if("pass").alias(n))
    one = passed(base, "pass_a").withColumn("_k", F.lit(1))
    for d in (passed(run, "pass_b"), new, changes.agg(F.count(F.lit(1)).alias("changes"))):
        one = one.join(F.broadcast(d.withColumn("_k", F.lit(1))), "_k")
    delta = F.col("pass_b") - F.col("pass_a")
    cls = F.when((F.abs(delta) >= fragile) | (F.col("new_failing") > 0), "fragile").when(F.col("changes") > 0, "sensitive").otherwise("stable")
    return one.select(cls.alias("class"), delta.alias("pass_delta"), "new_failing", "changes")


def compare_layouts(a: DataFrame, b: DataFrame, keys: list[str], entry: str, values: list[str], ratio: tuple[str, float]) -> DataFrame:
    """Per entry: rows equal, changed, missing on a side, and rows whose named value grew past a ratio."""
    tag = lambda d, t: d.select(*keys, *[F.col(v).alias(v + t) for v in values], F.lit(1).alias("in" + t))
    j = tag(a, "_a").join(tag(b, "_b"), keys, "full_outer")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    same = both
    for v in values:
        same = same & F.col(v + "_a").eqNullSafe(F.col(v + "_b"))
    grew = both & (F.col(ratio[0] + "_b") > F.col(ratio[0] + "_a") * ratio[1])
    return j.groupBy(entry).agg(
        F.count_if(same).alias("equal"), F.count_if(both & ~same).alias("changed"), F.count_if(F.col("in_b").isNull()).alias("missing_b"),
        F.count_if(F.col("in_a").isNull()).alias("missing_a"), F.count_if(grew).alias("grew"),
    )


def worse_measures(before: DataFrame, after: DataFrame, keys: list[str], higher: dict[str, bool]) -> DataFrame:
    """Measures that changed, and whether the wrong way; a lost value is worse. `higher`: measure -> higher is better."""
    long = lambda d, n: d.select(*keys, F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in higher]), F.array(*[F.col(m).cast("double") for m in higher]))).alias("measure", n))
    j = long(before, "before").join(long(after, "after"), [*keys, "measure"], "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    up = F.lit(False)
    for m, h in higher.items():
        up = up | ((F.col("measure") == m) & F.lit(h))
    worse = F.when(F.col("after").isNull(), True).when(F.col("before").isNull(), False).when(up, F.col("after") < F.col("before")).otherwise(F.col("after") > F.col("before"))
    return j.select(*keys, "measure", "before", "after", worse.alias("worse"))


def known_check(expected: DataFrame, diff: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows with whether the diff holds them."""
    return expected.join(diff.select(*keys).distinct().withColumn("_d", F.lit(1)), keys, "left").withColumn("found", F.col("_d").isNotNull()).drop("_d")


def code_mix(entries: DataFrame, version: str) -> DataFrame:
    """Entries by the version that measured them, and whether versions are mixed."""
    n = entries.groupBy(version).agg(F.count(F.lit(1)).alias("entries"))
    kinds = n.agg((F.count(F.lit(1)) > 1).alias("mixed"))
    return attach(n, kinds, [])


def scope_report(read: DataFrame, drawn: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """What a subset leaves out, per kind of thing (kind -> its key columns), with how many rows."""
    out = None
    for kind, keys in kinds.items():
        gone = read.select(*keys).distinct().join(drawn.select(*keys).distinct(), keys, "left_anti")
        part = gone.select(F.lit(kind).alias("kind"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("reason", F.lit("not drawn"))


def ratio(k: Column, n: Column) -> Column:
    return snap(k / F.nullif(n, F.lit(0)))
