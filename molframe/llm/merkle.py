"""A Merkle manifest of a dataset: leaves in trees of three, one tree for each source and one over the sources.

Every step is a shuffle by parent. A slot pivot (conditional aggregates) spreads the children of a parent into FANOUT
columns; concatenated they are hashed to the parent, and without a child's own column they are its siblings. The hash H is
the lowercase hex SHA-256 of its inputs, concatenated: a value is its byte count, `:` and itself, or `-` if null.

Places are numbered without one task for a source: rows are dealt in ranges of (source, doc_id), numbered where they lie,
and the ranges' counts are summed. A level holds a third of the rows of the level below, so all levels together cost about
half of the first. Every level is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut, parts

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """How a value goes into a hash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(parts_: list[Column]) -> Column:
    return F.sha2(F.concat(*parts_).cast("binary"), 256)


def leaf(**values: Column) -> Column:
    """The hash of a document; columns are taken by name, `values` in place of some of them."""
    return digest([field(values.get(c, F.col(c))) for c in FIELDS])


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """`rows` with pos, the place from 0 in its tree by `order`, and size, the tree's number of rows. Equal rows get
    different places. `tree` is not null. No task holds more than a range of rows, however large a tree is."""
    dealt = rows.repartitionByRange(parts(rows.sparkSession), tree, *order).sortWithinPartitions(tree, *order)
    dealt = cut(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")
    runs = dealt.groupBy(tree, part).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # at most one row for each range and tree
    before = W.Window.partitionBy(tree).orderBy("_part")
    runs = runs.select(
        tree, "_part", (F.coalesce(F.sum("_n").over(before.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(W.Window.partitionBy(tree)).alias("size"),
    )
    out = dealt.withColumn("_part", part).join(runs, [tree, "_part"])
    return out.withColumn("pos", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


def pivot(level: DataFrame, carry: list[str]) -> DataFrame:
    """One row a parent: tree, pos and size on its own level, h, and its children in the columns c0, c1, ... (struct of h
    and `carry`; null where it has fewer)."""
    child = F.struct("h", *carry)
    slots = [F.max(F.when(F.col("pos") % FANOUT == i, child)).alias(f"c{i}") for i in range(FANOUT)]
    up = level.groupBy("tree", F.floor(F.col("pos") / FANOUT).alias("_up"), "size").agg(*slots)
    hashes = [F.coalesce(F.col(f"c{i}.h"), F.lit("")) for i in range(FANOUT)]
    return up.select("tree", F.col("_up").alias("pos"), F.ceil(F.col("size") / FANOUT).alias("size"), digest(hashes).alias("h"), *[f"c{i}" for i in range(FANOUT)])


def siblings(slot: int) -> Column:
    """The hashes left and right of a child among its parent's columns: the own one is left out."""
    side = lambda slots: F.concat(F.lit(""), *[F.coalesce(F.col(f"c{i}.h"), F.lit("")) for i in slots])
    return F.struct(side(range(slot)).alias("left"), side(range(slot + 1, FANOUT)).alias("right"))


def climb(leaves: DataFrame, carry: list[str]) -> list[DataFrame]:
    """All levels above `leaves` (tree, pos, size, h, carry), lowest first, each tree up to its root. One level a round; there are
    log3 of the largest tree's size."""
    levels: list[DataFrame] = []
    below, held = leaves, carry
    left = leaves.agg(F.max("size")).first()[0] or 0
    while left > 1:
        below, held, left = cut(pivot(below.filter("size > 1"), held)), [], -(-left // FANOUT)
        levels.append(below)
    return levels


def roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, h): the node that remains of each tree."""
    out = leaves.filter("size = 1").select("tree", "h")
    for level in levels:
        out = out.unionByName(level.filter("size = 1").select("tree", "h"))
    return out


def descend(leaves: DataFrame, levels: list[DataFrame], carry: list[str], above: DataFrame | None = None) -> DataFrame:
    """`carry` and tree of every leaf with its path: the siblings (left, right) on each level from the leaf up, then the path
    of its tree in `above` (tree, path). Parents hand their path down to the children in their columns."""
    none = F.array().cast("array<struct<left:string,right:string>>")
    rest = lambda d: d.join(above, "tree") if above is not None else d.withColumn("path", none)
    alone = rest(leaves.filter("size = 1").select("tree", *carry))
    known: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        node = levels[k]
        top = rest(node.filter("size = 1"))
        if known is not None:
            top = top.unionByName(node.filter("size > 1").join(known.drop("size"), ["tree", "pos"]))
        down = [F.struct(F.col(f"c{i}").alias("child"), F.concat(F.array(siblings(i)), F.col("path")).alias("path"), (F.col("pos") * FANOUT + i).alias("pos")) for i in range(FANOUT)]
        child = top.select("tree", F.explode(F.filter(F.array(*down), lambda c: c["child"].isNotNull())).alias("n"))
        if k == 0:
            return alone.unionByName(child.select("tree", *[F.col(f"n.child.{c}").alias(c) for c in carry], F.col("n.path").alias("path")))
        known = child.select("tree", F.col("n.pos").alias("pos"), F.col("n.path").alias("path"))
    return alone


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def proof(path: Column) -> Column:
    """H of all siblings of a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, path (array of left, right) and changed (the hash of the row with `changed` in place
    of its text; the leaf itself if none is given), one row for each row of `docs`.

    Leaves of a source ascend by doc_id (null first), then by hash; a null source is the first tree. Nulls in any column go in as `-`,
    an empty text as `0:`. Repeated rows are leaves of their own. A table with one row has its leaf as root and an empty
    path; an empty table gives no row. Columns other than FIELDS are not read."""
    text = F.col("text") if changed is None else changed
    rows = docs.select(*FIELDS).select("doc_id", "source", leaf().alias("h"), leaf(text=text).alias("changed"))
    # null first: a code that no source begins with
    rows = cut(rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))))
    carry = ["doc_id", "source", "changed"]
    leaves = cut(placed(rows, "tree", ["doc_id", "h"]))
    levels = climb(leaves, carry)
    subs = roots(leaves, levels)
    over = placed(subs.select(F.lit(0).alias("_all"), F.col("tree").alias("of"), "h"), "_all", ["of"])
    over = cut(over.select(F.col("_all").cast("string").alias("tree"), "pos", "size", "h", "of"))
    tops = climb(over, ["of"])
    root = roots(over, tops).first()  # one row: the hash of all
    above = descend(over, tops, ["h", "of"]).select(F.col("of").alias("tree"), F.col("h").alias("subroot"), "path")
    above = cut(above.withColumn("root", F.lit(root["h"] if root else None).cast("string")))
    own = descend(leaves, levels, [*carry, "h"], above.select("tree", "path"))
    return own.join(above.select("tree", "subroot", "root"), "tree").select("doc_id", "source", F.col("h").alias("leaf"), "subroot", "root", "path", "changed")


def tampered(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text without line ends where the id's CRC-32 is even; a null id is not tampered with."""
    even = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))


def verified(docs: DataFrame) -> DataFrame:
    """The manifest of `docs`, checked against the rows after tampering: doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified (the folded root is the root)."""
    m = manifest(docs, tampered())
    m = m.withColumn("folded_root", folded(F.col("changed"), F.col("path")))
    return m.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
