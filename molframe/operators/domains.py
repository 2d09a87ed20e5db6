"""Domains from residue contacts: repeated lowest normalised cuts of every chain at once.

A chain is at most 800 points (a long one is cut into blocks of residues), so its table of contacts is bounded: contacts are found and
counted by joins and aggregates over all chains, then each chain's table is cut up in one call.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molframe.operators.chains import no_strays
from molframe.operators.contacts import element_contacts
from molframe.plans.spatial import pairs_within
from molframe.session import cut

CHAIN = ["entry", "chain"]
PART = ["entry", "chain", "part"]
LIMIT = 0.37
CUT_UP = ["point", "domain", "part", "ncut", "a", "b", "c", "d"]


def contact_graph(residues: DataFrame, r: float = 12.0, apart: int = 6, points: int = 800) -> tuple[DataFrame, DataFrame]:
    """(points: entry, chain, point, block; edges: entry, chain, p, q, w with p <= q) of CA contacts within 12, at
    least six residues apart. residues: entry, chain, pos (0-based), x, y, z."""
    n = residues.groupBy(*CHAIN).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("block", F.ceil(F.col("n") / F.lit(points)).cast("bigint"))
    pts = n.withColumn("point", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / F.col("block")).cast("bigint") - 1)))
    near = pairs_within(residues.select(*CHAIN, "pos", "x", "y", "z"), r, CHAIN, "pos", where=F.col("pos_b") - F.col("pos_a") >= apart)
    e = near.join(n, CHAIN).select(*CHAIN, F.floor(F.col("pos_a") / F.col("block")).cast("bigint").alias("p"), F.floor(F.col("pos_b") / F.col("block")).cast("bigint").alias("q"))
    return pts.select(*CHAIN, "point", "block", "n"), e.groupBy(*CHAIN, "p", "q").agg(F.count(F.lit(1)).alias("w"))


def _ncut(inner: np.ndarray, vol: np.ndarray, total: int) -> np.ndarray:
    """Cut over association of runs, to nine places; infinite where one side has no contacts."""
    across = (vol - inner).astype(float)
    ok = (vol > 0) & (total - vol > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(ok, np.floor((across / vol + across / (total - vol)) * 1e9 + 0.5) / 1e9, np.inf)


def lowest_cut(w: np.ndarray, least: int, piece: int) -> tuple | None:
    """The lowest cut of a part: value and the runs [a, b) and [c, d) (c None with one run), in the part's own places.

    w: contacts of its points, above and on the diagonal; a part has at most 800 points."""
    m = len(w)
    both = w + w.T
    prefix = lambda v: np.concatenate(([0], np.cumsum(v)))
    degree = prefix(both.sum(axis=1))
    total = int(degree[-1])
    # all runs [i, j): contacts inside (each from both its ends) and of its points; only starts that leave a whole piece before them
    inner = np.zeros((m, m + 1), dtype=np.int64)
    inner[:, 1:] = 2 * np.cumsum(np.cumsum(w[::-1], axis=0)[::-1], axis=1)
    i, j = np.arange(m)[:, None], np.arange(m + 1)[None, :]
    vol, size = degree[None, :] - degree[:m, None], j - i
    run = (size >= piece) & ((i == 0) | (i >= piece))
    end = (j == m) | (m - j >= piece)
    v = np.where(run & end & (size >= least) & (m - size >= least), _ncut(inner, vol, total), np.inf)
    a, b = (int(x) for x in np.unravel_index(np.argmin(v), v.shape))
    first = v[a, b]
    if not np.isfinite(first):
        return None
    touch = prefix(both[:, a:b].sum(axis=1))
    left = (j <= a) & ((j == a) | (a - j >= piece))
    right = (i >= b) & ((i == b) | (i - b >= piece)) & end
    joint = _ncut(inner[a, b] + 2 * (touch[None, :] - touch[:m, None]) + inner, vol[a, b] + vol, total)
    v = np.where(run & (left | right) & (m - (b - a) - size >= least), joint, np.inf)
    c, d = (int(x) for x in np.unravel_index(np.argmin(v), v.shape))
    return (float(v[c, d]), a, b, c, d) if v[c, d] < first else (float(first), a, b, None, None)


def residue_domains(residues: DataFrame, least: int = 40, piece: int = 20, limit: float = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(residues with domain, cuts made with confidence 1 - ncut/limit). Domains are numbered by first residue.

    All chains are cut in one pass: the contacts of a chain's at most 800 points come together and its parts are cut until none falls apart."""
    pts, edges = contact_graph(residues)
    edges = cut(edges)
    sizes = pts.groupBy(*CHAIN).agg(F.count(F.lit(1)).alias("m"), F.first("block").alias("block"))

    def cut_up(size: pa.Table, e: pa.Table) -> pa.Table:
        m, block = size.column("m")[0].as_py(), size.column("block")[0].as_py()
        w = np.zeros((m, m), dtype=np.int64)
        if e.num_rows:
            w[e.column("p").to_numpy(), e.column("q").to_numpy()] = e.column("w").to_numpy()
        small, short = -(-least // block), -(-piece // block)
        open_, done, cuts = [(1, np.arange(m))], [], []
        while open_:
            part, at = open_.pop()
            k = lowest_cut(w[np.ix_(at, at)], small, short) if len(at) >= small * 2 else None
            if k is None or k[0] >= limit:
                done.append((int(at[0]), part, at))
                continue
            side = np.zeros(len(at), dtype=bool)
            side[k[1] : k[2]] = True
            if k[3] is not None:
                side[k[3] : k[4]] = True
            cuts.append((part, *k))
            open_ += [(part * 2 + s, at[side == bool(s)]) for s in (0, 1)]
        rows = [(int(p), domain, part, None, None, None, None, None) for domain, (_, part, at) in enumerate(sorted(done, key=lambda x: x[0])) for p in at]
        rows += [(None, None, *c) for c in cuts]
        columns = dict(zip(CUT_UP, zip(*rows, strict=True), strict=True))
        bits = lambda p: (p + 2**63) % 2**64 - 2**63  # the name of a part many cuts deep
        columns["part"] = [bits(p) for p in columns["part"]]
        keys = {k: pa.array([size.column(k)[0].as_py()] * len(rows), size.schema.field(k).type) for k in CHAIN}
        return pa.table(keys | {k: pa.array(v, pa.float64() if k == "ncut" else pa.int64()) for k, v in columns.items()})

    types = ", ".join(f"{k} {residues.schema[k].dataType.simpleString()}" for k in CHAIN)
    schema = f"{types}, " + ", ".join(f"{k} {'double' if k == 'ncut' else 'bigint'}" for k in CUT_UP)
    made = cut(sizes.groupBy(*CHAIN).cogroup(edges.groupBy(*CHAIN)).applyInArrow(cut_up, schema))
    lab = made.filter("point is not null").select(*CHAIN, "point", "domain")
    cuts = made.filter("point is null").select(*PART, "ncut", "a", "b", "c", "d", (F.lit(1.0) - F.col("ncut") / limit).alias("confidence"))
    out = residues.join(sizes.select(*CHAIN, "block"), CHAIN).withColumn("point", F.floor(F.col("pos") / F.col("block")).cast("bigint"))
    return out.drop("block").join(lab, [*CHAIN, "point"]).drop("point"), cuts


def element_domains(residues: DataFrame, least: int = 30) -> DataFrame:
    """entry, chain, element, domain: the domain that holds most of an element, strays joined, and a domain with fewer
    than 30 element residues folded into the neighbour it has most contacts with, the smallest first.

    residues: entry, chain, pos, idx, element, domain, x, y, z."""
    inside = residues.filter("element is not null")
    votes = inside.groupBy(*CHAIN, "element", "domain").agg(F.count(F.lit(1)).alias("k"), F.min("pos").alias("at"))
    top = votes.groupBy(*CHAIN, "element").agg(F.min(F.struct((-F.col("k")).alias("k"), "domain")).alias("b"), F.sum("k").alias("residues"), F.min("at").alias("at"))
    lab = cut(top.select(*CHAIN, "element", F.col("b.domain").alias("domain"), "residues", "at"))
    w = Window.partitionBy(*CHAIN).orderBy("at")
    r = lab.withColumn("_new", F.coalesce((F.lag("domain").over(w) != F.col("domain")).cast("int"), F.lit(1)))
    r = r.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = no_strays(r.groupBy(*CHAIN, "run").agg(F.first("domain").alias("label"), F.sum("residues").alias("residues")), CHAIN)
    ends = kept.withColumn("_next", F.lead("run").over(Window.partitionBy(*CHAIN).orderBy("run"))).select(*CHAIN, F.col("run").alias("r0"), F.coalesce("_next", F.lit(1 << 40)).alias("r1"), "label")
    lab = r.join(ends, CHAIN).filter("run >= r0 and run < r1").select(*CHAIN, "element", F.col("label").alias("domain"), "residues")
    links = cut(element_contacts(residues.select("entry", "idx", "element", "x", "y", "z")))
    lab = cut(lab)
    while True:
        size = lab.groupBy(*CHAIN, "domain").agg(F.sum("residues").alias("n"))
        many = size.groupBy(*CHAIN).agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
        small = size.filter(F.col("n") < least).join(many, CHAIN, "left_semi").groupBy(*CHAIN).agg(F.min(F.struct("n", "domain")).alias("s"))
        small = small.select(*CHAIN, F.col("s.domain").alias("domain"))
        e = lab.select(*CHAIN, "element", "domain")
        two = links.select("entry", F.col("element_a").alias("x"), F.col("element_b").alias("y"), "ca_pairs")
        two = two.unionByName(two.select("entry", F.col("y").alias("x"), F.col("x").alias("y"), "ca_pairs"))
        j = two.join(e.withColumnRenamed("element", "x"), ["entry", "x"]).join(e.select(*CHAIN, F.col("element").alias("y"), F.col("domain").alias("other")), [*CHAIN, "y"])
        j = j.filter("domain <> other").join(small, [*CHAIN, "domain"], "left_semi").groupBy(*CHAIN, "domain", "other").agg(F.sum("ca_pairs").alias("c"))
        host = cut(j.groupBy(*CHAIN, "domain").agg(F.min(F.struct((-F.col("c")).alias("c"), "other")).alias("h")).select(*CHAIN, "domain", F.col("h.other").alias("host")))
        if host.isEmpty():
            return lab.drop("residues")
        lab = cut(lab.join(host, [*CHAIN, "domain"], "left").select(*CHAIN, "element", F.coalesce("host", "domain").alias("domain"), "residues"))
