"""Graphs of all entries at once: components, spanning trees, layered walks, longest tree paths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from molframe.plans.rounds import first_by
from molframe.session import cut


def both_ways(edges: DataFrame, group: list[str], a: str, b: str, keep: list[str] = ()) -> DataFrame:
    fwd = edges.select(*group, F.col(a).alias("src"), F.col(b).alias("dst"), *keep)
    return fwd.unionByName(edges.select(*group, F.col(b).alias("src"), F.col(a).alias("dst"), *keep))


#: edges that are worked out in one call
WHOLE = 1_000_000


def _numbered(t: pa.Table, group: list[str], columns: list[str]) -> tuple[pa.Array, list[np.ndarray]]:
    """All names in order, and the nodes of `columns` as numbers that are ordered by group and then by name."""
    code = np.zeros(t.num_rows, np.int64)
    for g in group:
        one = t[g].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(np.stack([code, one]), axis=1, return_inverse=True)
        code = code.ravel()
    names = pc.unique(pa.chunked_array([x for c in columns for x in t[c].chunks], t.schema.field(columns[0]).type))
    names = names.take(pc.sort_indices(names))
    return names, [code * len(names) + pc.index_in(t[c], names).to_numpy() for c in columns]


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`label` (the least node of each node's part) after the parts at both ends of every edge are one."""
    while len(x):
        one, two = label[x], label[y]
        least = np.minimum(one, two)
        np.minimum.at(label, one, least)
        np.minimum.at(label, two, least)
        while not np.array_equal(label, up := label[label]):
            label = up
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    return label


def _components_at_once(group: list[str]):
    def rows(t: pa.Table) -> pa.Table:
        names, (a, b) = _numbered(t, group, ["_a", "_b"])
        node, at = np.unique(np.concatenate([a, b]), return_index=True)
        label = _joined(np.arange(len(node)), np.searchsorted(node, a), np.searchsorted(node, b))
        kept = t.select(group).take(pa.array(at % max(1, len(a))))
        word = lambda v: names.take(pa.array(v % len(names)))
        return pa.table({g: kept[g] for g in group} | {"node": word(node), "component": word(node[label])})

    return rows


def _forest_at_once(group: list[str]):
    def rows(t: pa.Table) -> pa.Table:
        _, (a, b, pa_, pb) = _numbered(t, group, ["a", "b", "pa", "pb"])
        part = np.unique(np.concatenate([pa_, pb]))
        x, y = np.searchsorted(part, pa_), np.searchsorted(part, pb)
        unknown = t["weight"].is_null().to_numpy()
        least = np.where(unknown, -np.inf, -t["weight"].to_numpy().astype(np.float64))
        order = np.lexsort((b, a, least))
        x, y, label, taken = x[order], y[order], np.arange(len(part)), []
        at = np.arange(len(x))
        while len(at):
            # every part takes its best edge; the first in order is the best
            best = np.full(len(part), len(order))
            for end in (label[x[at]], label[y[at]]):
                np.minimum.at(best, end, at)
            now = np.unique(best[best < len(order)])
            taken.append(order[now])
            label = _joined(label, label[x[now]], label[y[now]])
            at = at[label[x[at]] != label[y[at]]]
        return t.select([*group, "a", "b", "weight"]).take(pa.array(np.concatenate([np.zeros(0, np.int64), *taken])))

    return rows


def _at_once(df: DataFrame, work, shape: StructType) -> DataFrame:
    """`work` on a small table, in one call."""
    return cut(df.coalesce(1).withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(lambda t: work(t.drop_columns(["_one"])), shape))


def _roots(up: DataFrame, group: list[str]) -> DataFrame:
    """`up` (group, node, parent), parents all below their nodes or the node itself, with the last of every line of parents as parent."""
    up = cut(up)
    while True:
        of = up.select(*group, F.col("node").alias("parent"), F.col("parent").alias("_p"))
        new = cut(up.join(of.hint("shuffle_hash"), [*group, "parent"]).select(*group, "node", F.col("_p").alias("parent"), (F.col("_p") != F.col("parent")).alias("_m")))
        moved = not new.filter("_m").isEmpty()
        up = new.drop("_m")
        if not moved:
            return up


def components(edges: DataFrame, group: list[str], a: str, b: str, at_once: bool = False) -> DataFrame:
    """(group, node, component): the component is named by its least node. With `at_once` the rounds end in one call when at most a million edges are left.

    Every node joins its least neighbour, lines of such steps are followed to their ends, and the ends alone go on, with the edges
    between them: edges shrink from round to round, so all rounds together cost little more than the first. The least node of a component
    joins no other and is its last end. Minima combine map-side, so a hub sends one row a task. Joins are not broadcast: a table of nodes
    is many times its written size in memory."""
    e = cut(edges.select(*group, F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).distinct())
    two = lambda d: d.select(*group, F.col("_a").alias("node"), F.col("_b").alias("_n")).unionByName(d.select(*group, F.col("_b").alias("node"), F.col("_a").alias("_n")))
    lab: DataFrame | None = None
    kind = {f.name: f.dataType for f in e.schema}
    shape = StructType([*[StructField(g, kind[g]) for g in group], StructField("node", kind["_a"]), StructField("component", kind["_a"])])
    while True:
        if at_once and e.limit(WHOLE + 1).count() <= WHOLE:
            last = _at_once(e.filter("_a is not null and _b is not null"), _components_at_once(group), shape)
            if lab is None:
                return last
            last = last.select(*group, F.col("node").alias("component"), F.col("component").alias("parent")).hint("shuffle_hash")
            return cut(lab.join(last, [*group, "component"], "left").select(*group, "node", F.coalesce("parent", "component").alias("component")))
        up = two(e).groupBy(*group, "node").agg(F.min("_n").alias("_n")).select(*group, "node", F.least("node", "_n").alias("parent"))
        up = _roots(up, group)
        if lab is None:
            lab = up.select(*group, "node", F.col("parent").alias("component"))
        else:
            last = up.select(*group, F.col("node").alias("component"), "parent").hint("shuffle_hash")
            lab = cut(lab.join(last, [*group, "component"], "left").select(*group, "node", F.coalesce("parent", "component").alias("component")))
        end = lambda c: up.select(*group, F.col("node").alias(c), F.col("parent").alias(c + "r")).hint("shuffle_hash")
        e = e.join(end("_a"), [*group, "_a"]).join(end("_b"), [*group, "_b"]).filter("_ar <> _br")
        e = cut(e.select(*group, F.least("_ar", "_br").alias("_a"), F.greatest("_ar", "_br").alias("_b")).distinct())
        if e.isEmpty():
            return lab


def max_spanning_forest(edges: DataFrame, group: list[str], a: str, b: str, weight: str) -> DataFrame:
    """Edges (a < b, one row each) of the heaviest forest. Every round each part takes its best outgoing edge; ties go
    to the lower ends, so no cycle can form."""
    e = edges.select(*group, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(weight).alias("weight"))
    e = cut(e.filter("a <> b").groupBy(*group, "a", "b").agg(F.max("weight").alias("weight")))
    nodes = e.select(*group, F.col("a").alias("node")).union(e.select(*group, F.col("b").alias("node"))).distinct()
    part = cut(nodes.withColumn("part", F.col("node")))
    tree: DataFrame | None = None
    rank = F.struct((-F.col("weight")).alias("w"), F.col("a").alias("a"), F.col("b").alias("b"))
    open_edges = e
    while True:
        side = lambda end, out: part.select(*group, F.col("node").alias(end), F.col("part").alias(out)).hint("shuffle_hash")
        open_edges = open_edges.drop("pa", "pb").join(side("a", "pa"), [*group, "a"]).join(side("b", "pb"), [*group, "b"])
        # of the edges between two parts only the best can be taken
        pair = [F.least("pa", "pb").alias("pa"), F.greatest("pa", "pb").alias("pb")]
        open_edges = open_edges.filter("pa <> pb").groupBy(*group, *pair).agg(F.min(rank).alias("_r"))
        open_edges = cut(open_edges.select(*group, F.col("_r.a").alias("a"), F.col("_r.b").alias("b"), (-F.col("_r.w")).alias("weight"), "pa", "pb"))
        if open_edges.limit(WHOLE + 1).count() <= WHOLE:
            rest = _at_once(open_edges, _forest_at_once(group), e.select(*group, "a", "b", "weight").schema)
            return rest if tree is None else tree.unionByName(rest)
        ends = open_edges.select(*group, F.col("pa").alias("part"), rank.alias("_r")).union(
            open_edges.select(*group, F.col("pb").alias("part"), rank.alias("_r"))
        )
        best = ends.groupBy(*group, "part").agg(F.min("_r").alias("_r")).select(*group, "_r").distinct()
        picked = best.select(*group, F.col("_r.a").alias("a"), F.col("_r.b").alias("b"), (-F.col("_r.w")).alias("weight"))
        picked = cut(picked)
        tree = picked if tree is None else tree.unionByName(picked)
        joins = picked.join(side("a", "pa"), [*group, "a"]).join(side("b", "pb"), [*group, "b"])
        comp = components(joins, group, "pa", "pb", True).select(*group, F.col("node").alias("part"), "component")
        part = part.join(comp.hint("shuffle_hash"), [*group, "part"], "left")
        part = cut(part.select(*group, "node", F.coalesce("component", "part").alias("part")))


def bfs(edges: DataFrame, group: list[str], a: str, b: str, roots: DataFrame, sign: Column | None = None,
        directed: bool = False) -> DataFrame:
    """(group, node, depth, parent, sign) of a layered walk from `roots` (group, node). The parent is the least node
    of the layer before; `sign` (+1 or -1 on an edge) multiplies along the way."""
    e = edges.withColumn("_sign", (sign if sign is not None else F.lit(1)).cast("int"))
    e = e.select(*group, F.col(a).alias("src"), F.col(b).alias("dst"), "_sign") if directed else both_ways(e, group, a, b, ["_sign"])
    e = cut(e.groupBy(*group, "src", "dst").agg(F.max("_sign").alias("_sign")))
    front = cut(roots.select(*group, "node").distinct().withColumn("depth", F.lit(0))
                .withColumn("parent", F.lit(None).cast(e.schema["src"].dataType)).withColumn("sign", F.lit(1)))
    layers = [front]
    while not layers[-1].isEmpty():
        front = layers[-1]
        step = front.select(*group, F.col("node").alias("src"), F.col("sign").alias("_from")).hint("shuffle_hash").join(e, [*group, "src"])
        # without directions a neighbour lies at most one layer away, so older layers need no look
        for old in layers if directed else layers[-2:]:
            step = step.join(old.select(*group, F.col("node").alias("dst")).hint("shuffle_hash"), [*group, "dst"], "left_anti")
        step = step.groupBy(*group, F.col("dst").alias("node")).agg(
            F.min(F.struct(F.col("src"), (F.col("_from") * F.col("_sign")).alias("s"))).alias("_p")
        )
        layers.append(cut(step.select(*group, "node", F.lit(len(layers)).alias("depth"), F.col("_p.src").alias("parent"), F.col("_p.s").alias("sign"))))
    seen = layers[0]
    for layer in layers[1:-1]:
        seen = seen.unionByName(layer)
    return cut(seen)


def farthest(walk: DataFrame, key: list[str]) -> DataFrame:
    """Deepest node of each key, the least one on a tie."""
    best = walk.groupBy(*key).agg(F.min(F.struct((-F.col("depth")).alias("d"), F.col("node").alias("n"))).alias("_b"))
    return best.select(*key, F.col("_b.n").alias("node"), (-F.col("_b.d")).alias("depth"))


#: leaves that one node keeps in a tree too large for one call
LEAVES = 3


def _walked_track(tree: DataFrame, comp: DataFrame, group: list[str], a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """`tree_track` by three layered walks, one join a layer."""
    key = [*group, "component"]
    roots = comp.filter(F.col("node") == F.col("component"))
    one = bfs(tree, group, a, b, roots).join(comp.hint("shuffle_hash"), [*group, "node"])
    start = cut(farthest(one, key))
    two = cut(bfs(tree, group, a, b, start).join(comp.hint("shuffle_hash"), [*group, "node"]))
    end = cut(farthest(two, key))
    three = bfs(tree, group, a, b, end).select(*group, "node", F.col("depth").alias("_back"))
    # in a tree the path between two nodes is where the two distances add up to the whole
    j = two.join(three.hint("shuffle_hash"), [*group, "node"]).join(end.select(*key, F.col("depth").alias("_whole")), key)
    track = cut(j.filter(F.col("depth") + F.col("_back") == F.col("_whole")).select(*key, "node", F.col("depth").alias("place")))
    off = two.join(track.select(*group, "node").hint("shuffle_hash"), [*group, "node"], "left_anti").select(*key, "node", "parent")
    return track, off


def _peeled(group: list[str]):
    """The rows of whole trees: place of a node on the longest path, or its parent.

    Leaves are taken away until one node or one edge is left, the middle of every longest path. What a node was taken away with, its height and
    the least of its deepest nodes, says which two branches hold the ends."""

    def rows(t: pa.Table) -> pa.Table:
        names, (a, b, root) = _numbered(t, group, ["a", "b", "component"])
        node, at = np.unique(np.concatenate([a, b]), return_index=True)
        row = at % len(a)  # a row of the node's tree
        x, y, top = np.searchsorted(node, a), np.searchsorted(node, b), np.searchsorted(node, root[row])
        n = len(node)
        left, other = np.bincount(np.concatenate([x, y]), minlength=n), np.zeros(n, np.int64)
        np.bitwise_xor.at(other, x, y)
        np.bitwise_xor.at(other, y, x)
        height, parent = np.zeros(n, np.int64), np.full(n, -1)
        deep, low = np.arange(n), np.arange(n)
        leaf, done = np.flatnonzero(left == 1), 0
        while len(leaf):
            up = other[leaf]
            parent[leaf], height[leaf] = up, done
            # of the two ends of an edge that is left neither is below the other
            under = ~((left[up] == 1) & (other[up] == leaf))
            child, over = leaf[under], up[under]
            # the deepest below a node are below those taken away last
            rank = np.lexsort((deep[child], over))
            first = rank[np.flatnonzero(np.diff(over[rank], prepend=-1))]
            deep[over[first]] = deep[child[first]]
            np.minimum.at(low, over, low[child])
            np.subtract.at(left, up, 1)
            np.bitwise_xor.at(other, up, leaf)
            left[leaf] = 0
            done += 1
            leaf = np.unique(over)
            leaf = leaf[left[leaf] == 1]
        middle = np.flatnonzero(parent < 0)
        twin = np.flatnonzero((parent >= 0) & (parent[np.maximum(parent, 0)] == np.arange(n)))
        # branches at the middle that reach the ends: below a node, or either side of an edge
        branch = np.concatenate([np.flatnonzero((parent >= 0) & (parent[np.maximum(parent, 0)] < 0)), twin])
        tree = top[branch]
        reach = np.full(n, -1)
        np.maximum.at(reach, tree, height[branch])
        branch = branch[height[branch] == reach[tree]]
        tree = top[branch]
        start, end = np.full(n, n), np.full(n, n)
        # the first end is as far as can be from the tree's least node, so in another branch
        free = low[branch] != tree
        np.minimum.at(start, tree[free], deep[branch][free])
        rest = deep[branch] != start[tree]
        np.minimum.at(end, tree[rest], deep[branch][rest])
        whole = 2 * reach + 2
        whole[top[twin]] -= 1
        place = np.full(n, -1)
        place[middle] = reach[top[middle]] + 1
        below = parent >= 0
        first, last = below & (deep == start[top]), below & (deep == end[top])
        place[first], place[last] = height[first], (whole[top] - height)[last]
        on = place >= 0
        word = lambda v, off=None: names.take(pa.array(node[np.maximum(v, 0)] % len(names), mask=off))
        kept = t.take(pa.array(row))
        out = {g: kept[g] for g in group} | {"component": kept["component"], "node": word(np.arange(n)), "place": pa.array(place.astype(np.int32), mask=~on), "parent": word(parent, on)}
        return pa.table(out)

    return rows


def tree_track(tree: DataFrame, group: list[str], a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """The longest path of every tree (group, component, node, place), and the nodes off it (group, component, node, parent).

    The path begins at the node farthest from the tree's least one and ends at the node farthest from that, the least of equally far ones. A tree of
    at most a million edges is worked out in one call, many small ones together. A larger one first loses all but the least three leaves of every
    node, for no other can be an end; what is larger still is walked layer by layer."""
    group, key = list(group), [*group, "component"]
    comp = cut(components(tree, group, a, b, True))
    e = tree.select(*group, F.col(a).alias("a"), F.col(b).alias("b"))
    e = cut(e.join(comp.withColumnRenamed("node", "a").hint("shuffle_hash"), [*group, "a"]))
    larger = lambda d: cut(d.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > WHOLE).select(*key))
    big, lost, walked = larger(e), None, None
    if not big.isEmpty():
        rest = cut(e.join(big, key, "left_semi"))
        ends = rest.select(*key, F.col("a").alias("node"), F.col("b").alias("parent")).unionByName(rest.select(*key, F.col("b").alias("node"), F.col("a").alias("parent")))
        leaves = ends.groupBy(*key, "node").agg(F.count(F.lit(1)).alias("_n"), F.min("parent").alias("parent")).filter("_n = 1").drop("_n")
        few = first_by(leaves, [*key, "parent"], [F.col("node")], LEAVES).drop("rank")
        lost = cut(leaves.join(few, [*key, "node"], "left_anti"))
        without = lambda d, end: d.join(lost.select(*group, F.col("node").alias(end)).hint("shuffle_hash"), [*group, end], "left_anti")
        rest = cut(without(without(rest, "a"), "b"))
        e = e.join(big, key, "left_anti")
        big = larger(rest)
        if big.isEmpty():
            e = e.unionByName(rest)
        else:
            e = e.unionByName(rest.join(big, key, "left_anti"))
            rest = cut(rest.join(big, key, "left_semi"))
            walked = _walked_track(rest, comp.join(big, key, "left_semi").join(lost, [*group, "node"], "left_anti"), group, "a", "b")
        e = cut(e)
    n = max(int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-e.count() // WHOLE))
    kind = {f.name: f.dataType for f in e.schema}
    shape = StructType([*[StructField(g, kind[g]) for g in group], StructField("component", kind["a"]), StructField("node", kind["a"]), StructField("place", IntegerType()), StructField("parent", kind["a"])])
    rows = cut(e.withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(n))).groupBy("_b").applyInArrow(_peeled(group), shape))
    track = rows.filter("place is not null").select(*key, "node", "place")
    off = rows.filter("place is null").select(*key, "node", "parent")
    if walked:
        track, off = track.unionByName(walked[0]), off.unionByName(walked[1])
    return track, off if lost is None else off.unionByName(lost.select(*off.columns))


def cyclic_flag(edges: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """(group, component, nodes, edges, closed): closed when there are at least as many edges as nodes."""
    e = edges.select(*group, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()
    comp = cut(components(e, group, "a", "b"))
    n = comp.groupBy(*group, "component").agg(F.count(F.lit(1)).alias("nodes"))
    m = e.join(comp.withColumnRenamed("node", "a").hint("shuffle_hash"), [*group, "a"]).groupBy(*group, "component").agg(F.count(F.lit(1)).alias("edges"))
    return n.join(m, [*group, "component"]).withColumn("closed", F.col("edges") >= F.col("nodes"))
