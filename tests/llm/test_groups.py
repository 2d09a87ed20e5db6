"""op1, op5, op7 and op8 against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
from molframe.llm import exact, minhash, mixing, sharding


def brute_near(rows):
    sets = {}
    for i, t, *_ in rows:
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def test_near_duplicates(docs, rows, nothing):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = brute_near(rows)
    assert {r[0]: tuple(r[1:]) for r in got} == want
    assert want[30][1] == 3 and want[37][1] == 36
    assert minhash.near_duplicates(nothing).count() == 0


def test_chain_of_near_texts(spark):
    """Each text is near the next only; not all links are with a band's smallest document."""
    words = [f"v{i}" for i in range(400)]
    texts = []
    for step in range(4):
        w = list(words)
        for j in range(step):
            for x in range(5):
                w[80 * j + 13 * x + 5] = f"u{j}{x}"
        texts.append((step * 3 % 4, " ".join(w)))
    rows = [*texts, (100, texts[1][1])]
    want = brute_near(rows)
    assert {w[1] for w in want.values()} == {0}
    assert brute_near([rows[0], rows[3]])[1][1] == 1  # the ends of the chain are not near
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_pairs_of_a_band_in_blocks(spark):
    rows, sets = [], {}
    for i in range(60):
        n = 60 + i
        sets[i] = np.unique(np.concatenate([np.arange(n - i % 7 * 4), 1000 * (i + 1) + np.arange(i % 7 * 4)]).astype(np.uint64))
        sign = minhash.signatures([sets[i]])[0]
        rows.append((i, i % 15, len(sets[i]), sign.tobytes(), [int(x) for x in sets[i]]))
    table = spark.createDataFrame(rows, "doc_id long, component long, n_shingles long, signature binary, shingles array<long>")
    banded = minhash.bands(table).join(table.select("doc_id", "component", "n_shingles"), "doc_id")

    def near(a, b):
        both = len(np.intersect1d(sets[a], sets[b]))
        return a < b and a % 15 != b % 15 and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)

    want = {(a, b) for a in sets for b in sets if near(a, b)}
    assert len(want) > 100
    for block in (2048, 7):
        got = [tuple(sorted(r)) for r in minhash.close_pairs(banded, table, table.select("doc_id", "shingles"), 75, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    got = {r[0]: r[1] for r in minhash.components(spark.createDataFrame(path + star + [(7, 7)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


def test_exact_copies(docs, rows, nothing):
    for capacity in (65_536, 2):
        got = exact.dedup(docs, capacity=capacity).collect()
        norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, *_ in rows]
        size, first = collections.Counter(t for _, t in norm), {}
        for i, t in sorted(norm):
            first.setdefault(t, i)
        want = sorted((i, first[t], size[t], first[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
        assert sorted(tuple(r) for r in got) == want
    assert exact.dedup(nothing).count() == 0


def test_directory_splits_full_buckets(spark):
    h = spark.range(4096).selectExpr("xxhash64(id) as h").union(spark.createDataFrame([(1,)] * 9, "h long"))
    slots, bits = exact.directory(h, 64)
    got = slots.collect()
    assert bits >= 6 and len({r.slot for r in got}) == len(got)
    for r in got:
        assert r.bucket == r.slot >> (bits - r.depth) << (bits - r.depth)
    held = collections.Counter()
    of = {r.slot: r.bucket for r in got}
    for (x,) in h.distinct().collect():
        held[of[(x & (1 << 64) - 1) >> (64 - bits)]] += 1
    assert max(held.values()) <= 64 and sum(held.values()) == 4097


def test_shards(docs, rows, nothing):
    for block in (8192, 8):
        got = sharding.shard(docs, bins=4, block=block).toPandas()
        assert len(got) == len(rows)
        assert got["size"].sum() == sum(len((t or "").encode()) + 1 for _, t, *_ in rows)
        for _, part in got.groupby("shard"):
            assert sorted(part.slot) == list(range(len(part)))
        crc = {i: zlib.crc32((t or "").encode()) for i, t, *_ in rows}
        assert all(crc[i] == c for i, c in zip(got.doc_id, got.text_crc32))
        small = [i for i, t, *_ in rows if t == rows[0][1]]
        assert got[got.doc_id.isin(small)].shard.nunique() == 1
        assert got.grown_shard.isna().all() and set(got.law) == {"bytes"}
    assert sharding.shard(nothing).count() == 0


def test_shards_of_a_group_with_most_rows(spark):
    rows = [(i, "same text of a large group") for i in range(600)] + [(1000 + i, "other %d " % i * (i % 9)) for i in range(400)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), bins=8, block=64).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() - size.min() < 0.05 * size.mean()


def test_shards_of_a_group_with_most_rows_and_few_bytes(spark):
    rows = [(i, None) for i in range(1000)] + [(1000 + i, "other %d words " % i * 20) for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), bins=8).toPandas()
    for size in (got.groupby("shard").doc_id.count(), got.groupby("shard")["size"].sum(), got.groupby("shard").tokens.sum()):
        assert len(size) == 8 and size.max() - size.min() < 0.1 * size.mean()


def test_levels_of_packing(spark):
    units = spark.range(3000).selectExpr("cast(id as string) as unit", "1 + id * 7919 % 500 as bytes", "1 + id % 40 as tokens", "1L as rows")
    got = sharding.place(units, 2, 512).join(units, "unit").groupBy("shard").agg({"bytes": "sum", "rows": "sum"}).collect()
    assert sum(r["sum(rows)"] for r in got) == 3000
    size = [r["sum(bytes)"] for r in got]
    assert len(size) == 2 and max(size) / min(size) < 1.01


def test_packing_balances_all_sizes():
    rng = np.random.default_rng(1)
    vectors = np.column_stack([rng.lognormal(8, 1, 3000), rng.lognormal(6, 1, 3000), np.ones(3000)])
    into = sharding.pack(vectors, 8)
    ratio = [total.max() / total.min() for total in (np.bincount(into, vectors[:, c], minlength=8) for c in range(3))]
    assert ratio[0] < 1.001 and max(ratio) < 1.05


def test_mixture(spark, nothing):
    rows = [(i, "word " * (1 + i % 13) + "| a | b" * (i % 5 == 0), ["en", "de", None][i % 3], f"s{i % 4}", None) for i in range(240)]
    rows += [(500, None, None, None, None), (501, "", "en", "s0", None), (3, rows[3][1], rows[3][2], rows[3][3], None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight long"), power=0.5).toPandas()
    assert len(got) == len(rows)
    assert got.probability.between(0, 1).all() and abs(got.probability.max() - 1) < 1e-12
    share = (got.tokens * got.weight).groupby(got.topic).sum() / (got.tokens * got.weight).sum()
    target = got.groupby("topic").tokens.sum() ** 0.5
    assert np.allclose(share, target / target.sum(), atol=1e-5)
    assert got[got.doc_id == 3].kept.nunique() == 1
    assert mixing.mix(nothing).count() == 0


def cells_of(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, target_source double, target_lang double, target_topic double")


def test_raking_meets_all_margins(spark):
    part = {"a": 0.5, "b": 0.5, "x": 0.2, "y": 0.8, "t": 0.3, "u": 0.7}
    rows = [(s, g, t, 3 + 7 * i + 2 * j + k, part[s], part[g], part[t]) for i, s in enumerate("ab") for j, g in enumerate("xy") for k, t in enumerate("tu")]
    got = mixing.rake(cells_of(spark, rows)).toPandas()
    for margin in ("source", "lang", "topic"):
        for name, share in got.groupby(margin).weight.sum().items():
            assert abs(share - part[name]) < 1e-5


def test_targets_that_contradict(spark):
    got = mixing.rake(cells_of(spark, [("a", "x", "t", 5, 0.9, 0.2, 1.0), ("b", "y", "t", 5, 0.1, 0.8, 1.0)]), most=3).toPandas()
    assert abs(got.weight.sum() - 1) < 1e-9
