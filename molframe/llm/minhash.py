"""Near-duplicates by MinHash: signatures, bands, checks, and connected components by large-star and small-star.

Each document's signature holds the minima of 128 universal hashes over its 5-word shingles. 32 bands of four minima make
candidates: at a similarity of 0.75 a pair shares no band once in 200,000 times. A candidate pair whose signatures agree
in less than half is dropped (at 0.75 that is 6.5 deviations away), any other is checked on the full shingle sets.

A band's documents are not paired with each other. First each is checked against the band's smallest. Then only bands
whose documents are still in different components go on, split by set size: linked sets differ by a quarter of their size
at most, so a document meets its own and the next size class. There signatures, then full sets, are compared inside tasks
of BLOCK times BLOCK documents, a pair in the first band it shares, and only links between different components come out.
A pair goes unchecked only if its two documents are already connected, so the components are those of all links that the
bands can find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, cut, flat, parts, portions, raw, release
from .repeats import _grams, word_hashes, words_of

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS  # a power of two
LEAST_AGREEMENT = 0.5
BLOCK = 2048
_RNG = np.random.default_rng(5)
FACTORS = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
STRETCH = 1 << 15


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a batch. A-Z are lower-cased; texts of fewer than k words are one
    shingle, texts without words have none."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, w_at = words_of(data, at)
    words = word_hashes(data, starts, ends)
    grams = _grams(words, k) if len(words) >= k else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(w_at[:-1].tolist(), w_at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh64_intdigest(words[a:b].tobytes())], dtype=np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The high half of each hash's minimum, one row of HASHES for each set (none of them empty)."""
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= STRETCH):
            n += len(sets[j])
            j += 1
        x = np.concatenate(sets[i:j])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[i : j - 1]])]).astype(np.int64)
        y = np.empty_like(x)
        for h in range(HASHES):
            np.multiply(x, FACTORS[h], out=y)
            np.add(y, SHIFTS[h], out=y)
            out[i:j, h] = np.minimum.reduceat(y, at) >> np.uint64(32)
        i = j
    return out


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, digest, signature); the last two are null for an empty set. Equal digests: equal sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, most=1 << 20):
            sets = shingle_sets(*flat(b.column("body")), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            made = signatures([sets[i] for i in full]) if full else []
            digest, signature = [None] * len(sets), [None] * len(sets)
            for i, row in zip(full, made, strict=True):
                digest[i], signature[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary())], names=["doc_id", "n_shingles", "digest", "signature"])

    return docs.select("doc_id", raw().alias("body")).mapInArrow(work, "doc_id long, n_shingles long, digest binary, signature binary")


def bands(signs: DataFrame) -> DataFrame:
    """(key, doc_id), a row for each document and band. The last bits of a key are the band's number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(flat(b.column("signature"))[0].tobytes(), dtype=np.uint32).reshape(b.num_rows, -1, ROWS)
            key = np.zeros(sig.shape[:2], dtype=np.uint64) + np.arange(1, sig.shape[1] + 1, dtype=np.uint64)
            for r in range(ROWS):
                key = (key ^ sig[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            key = key & ~np.uint64(BANDS - 1) | np.arange(BANDS, dtype=np.uint64)
            ids = np.repeat(b.column("doc_id").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64).ravel()), pa.array(ids)], names=["key", "doc_id"])

    return signs.select("doc_id", "signature").mapInArrow(work, "key long, doc_id long")


def agreeing(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree well enough for a full check."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(flat(b.column(c))[0].tobytes(), dtype=np.uint32).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield b.filter(pa.array((x == y).mean(axis=1) >= LEAST_AGREEMENT)).select(["a", "b"])

    side = lambda c: signs.select(F.col("doc_id").alias(c), F.col("signature").alias(f"sig_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sig_a", "sig_b").mapInArrow(work, "a long, b long")


def close_pairs(rows: DataFrame, signs: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Linked pairs (a, b) of one band and of different components. `rows` has key, doc_id, component, n_shingles; `signs`
    and `sets` hold the documents' signatures and shingles. A size class goes up to 4/3 of its least size."""
    size = F.floor(F.log("n_shingles") / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    met = rows.withColumn("home", size).withColumn("meet", F.explode(F.array("home", F.col("home") + 1)))
    counts = met.groupBy("key", "meet").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = met.join(counts, ["key", "meet"]).withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))
    dealt = dealt.drop("n", "n_shingles", "blocks", "other")
    small = signs.select("doc_id", "signature")
    n = 16 * parts(rows.sparkSession)
    bucket = F.pmod(F.xxhash64("key", "meet", "x", "y"), F.lit(n)).alias("bucket")
    # signatures alone first: the sets of documents that agree with no other need not travel
    likely = cut(dealt.join(small, "doc_id").groupBy(bucket).applyInArrow(_likely, "key long, meet int, x int, y int, doc_id long, component long, mine int, home int"))

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by(BLOCK_ORDER)
        doc = t.column("doc_id").to_numpy()
        lists = t.column("shingles").combine_chunks()
        values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        a, b = [], []
        for i, near in _partners(t):
            own = values[at[i] : at[i + 1]]
            for j in near.tolist():
                theirs = values[at[j] : at[j + 1]]
                shared = len(np.intersect1d(own, theirs, assume_unique=True))
                if 100 * shared >= percent * (len(own) + len(theirs) - shared):
                    a.append(doc[i])
                    b.append(doc[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return likely.join(sets, "doc_id").join(small, "doc_id").groupBy(bucket).applyInArrow(work, "a long, b long")


BLOCK_ORDER = [(c, "ascending") for c in ("key", "meet", "x", "y", "doc_id")]


def _partners(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For rows in BLOCK_ORDER: each with those after it that it is to be compared with here and whose signature agrees."""
    names = ("key", "meet", "x", "y", "component", "mine", "home")
    key, meet, x, y, comp, mine, home = (t.column(c).to_numpy() for c in names)
    sig = np.frombuffer(flat(t.column("signature"))[0].tobytes(), dtype=np.uint32).reshape(len(key), -1)
    turn = (key[1:] != key[:-1]) | (meet[1:] != meet[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    edge = np.flatnonzero(np.concatenate([[True], turn, [True]]))
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        band = int(key[s]) & (BANDS - 1)
        for i in range(s, e - 1):
            other = np.arange(i + 1, e)
            # two guests have met in their own class; in a task of two blocks only documents of both
            use = (comp[other] != comp[i]) & ((home[i] == meet[i]) | (home[other] == meet[i]))
            if x[i] != y[i]:
                use &= mine[other] != mine[i]
            other = other[use]
            if not len(other):
                continue
            same = sig[other] == sig[i]
            other, same = other[near := same.mean(axis=1) >= LEAST_AGREEMENT], same[near]
            other = other[same.reshape(len(other), BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
            if len(other):
                yield i, other


def _likely(t: pa.Table) -> pa.Table:
    """The rows whose signature agrees with another's that they are to be compared with."""
    t = t.sort_by(BLOCK_ORDER)
    hit = np.zeros(len(t), dtype=bool)
    for i, near in _partners(t):
        hit[i] = True
        hit[near] = True
    return t.select(["key", "meet", "x", "y", "doc_id", "component", "mine", "home"]).filter(pa.array(hit))


def shingle_table(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles) of the documents named in `wanted`, bucketed by doc_id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            sets = shingle_sets(*flat(b.column("body")), k)
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).astype(np.int64)))], names=["doc_id", "shingles"])

    return by_key(docs.select("doc_id", raw().alias("body")).join(wanted, "doc_id").mapInArrow(work, "doc_id long, shingles array<long>").dropDuplicates(["doc_id"]), "doc_id")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * shared >= percent * all shingles. `a` may be in any number of pairs: Spark splits that join."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"set_{c}"))
    heads = cut(pairs.select("a").distinct().join(side("a"), "a"))
    both = pairs.join(side("b"), "b").join(heads, "a").withColumn("shared", F.size(F.array_intersect("set_a", "set_b")))
    return both.filter(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.size("set_a") + F.size("set_b") - F.col("shared"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component): the smallest id reachable over edges (a, b), by alternating large-star and small-star."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = cut(small.filter("u != v").distinct())
        after = mark(edges)
        if after == before:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component"))
        before = after


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`.

    Documents are linked when 100 * shared >= percent * all distinct shingles of k words (of bytes other than white space,
    A-Z lower-cased; fewer words make one shingle). `component_id` is the smallest doc_id reachable over links. Null and
    empty texts have no shingles and no links. Documents with equal sets are one in all steps. Rows that repeat a doc_id
    share its fate; a row without doc_id joins its copies and is never kept. An empty table gives an empty result. Other
    columns are not read."""
    signs = cut(signed(docs, k))
    firsts = signs.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    own = cut(signs.filter("digest is not null").join(firsts.filter("first is not null").select(F.col("first").alias("doc_id")).distinct(), "doc_id").select("doc_id", "n_shingles", "signature").dropDuplicates(["doc_id"]))
    release(docs.sparkSession)
    rows = bands(own)
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("head")).filter("n > 1")
    rest = cut(rows.join(shared.select("key", "head"), "key"))
    sets = shingle_table(docs, rest.select("doc_id").distinct(), k)
    release(docs.sparkSession)
    pairs = rest.filter("doc_id != head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = cut(linked(cut(agreeing(pairs, own)), sets, percent))
    found = components(links)
    labelled = rest.join(found, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    open_ = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("key")
    sizes = own.select("doc_id", "n_shingles")
    fresh = cut(close_pairs(labelled.join(open_, "key").join(sizes, "doc_id"), own, sets, percent))
    if not fresh.isEmpty():
        found = components(found.select(F.col("doc_id").alias("a"), F.col("component").alias("b")).unionByName(fresh))
    release(docs.sparkSession)
    named = signs.select("doc_id", "n_shingles", "digest").join(firsts, "digest", "left").join(found.withColumnRenamed("doc_id", "first"), "first", "left")
    component = F.coalesce("component", "first", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
