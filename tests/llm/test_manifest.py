"""op11 to op13: trees against hashlib, cuts against re, toxic spans against enumeration and planted words."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from molframe.llm import infill, merkle, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# ---------------------------------------------------------------- op11
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row, text):
    return sha(*map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, pos):
    out = []
    for level in tree[:-1]:
        run = pos // 3 * 3
        out.append((level[run:pos], level[pos + 1 : run + 3]))
        pos //= 3
    return out


def whole(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    first = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]))
    trees = {}
    for s in names:
        by_source[s].sort(key=first)
        trees[s] = levels([leaf_of(r, r["text"]) for r in by_source[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for pos, r in enumerate(by_source[s]):
            p = path(trees[s], pos) + path(top, i)
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            h = leaf_of(r, r["text"].replace("\n", "") if bad else r["text"])
            for left, right in p:
                h = sha(*left, h, *right)
            out.append((r["doc_id"], leaf_of(r, r["text"]), trees[s][-1][0], top[-1][0], sha(*(x for left, right in p for x in left + right)), h, h == top[-1][0]))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in merkle.verified(docs).collect()), key=str)


def test_manifest_equals_hashlib(docs, rows):
    names = ("doc_id", "text", "lang", "source", "n_chars")
    assert got(docs) == whole([dict(zip(names, r)) for r in rows])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_manifest_of_one_source_of_any_size(spark, n):
    rng = random.Random(n)
    rows = [(i, "a\nb" if i % 2 else None, "en", None if n == 4 else "s", 3) for i in range(n)]
    rng.shuffle(rows)
    names = ("doc_id", "text", "lang", "source", "n_chars")
    assert got(spark.createDataFrame(rows, SCHEMA)) == whole([dict(zip(names, r)) for r in rows])


def test_manifest_of_null_ids_and_odd_sources(spark):
    rows = [(None, "x", None, "", None), (None, "x", None, "", None), (None, None, None, None, None), (2, "\n", "de", "é", 1), (1, "", "de", "z", 0), (-5, "y", "de", "=", 1)]
    names = ("doc_id", "text", "lang", "source", "n_chars")
    assert got(spark.createDataFrame(rows, SCHEMA)) == whole([dict(zip(names, r)) for r in rows])


def test_manifest_of_nothing(nothing):
    assert merkle.verified(nothing).collect() == []


def test_a_changed_row_is_found(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 3}", 6) for i in range(40)]
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA), F.when(F.col("doc_id") == 7, F.lit("other")).otherwise(F.col("text")))
    bad = out.filter(merkle.folded(F.col("changed"), F.col("path")) != F.col("root")).collect()
    assert [r.doc_id for r in bad] == [7]


# ---------------------------------------------------------------- op12
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def filled(doc_id, text, rate=50, spm=80):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    unit = UNIT.findall(text)
    n = len(unit)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(unit[:a]), "".join(unit[a:b]), "".join(unit[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(12)
    out = [None, "", " ", "\n\t", "a", " a", "a ", "a<P>b", "<S>", "x <M", "<", "< P >", "é", "🙂 ñ x ", "a\x0bb\x0cc\x1cd"]
    for _ in range(120):
        out.append("".join(rng.choice(["a", "é", "🙂", " ", "\n", "word", "<", "S>", "\t\t", "<M>" if rng.random() < 0.02 else "z"]) for _ in range(rng.randrange(1, 400))))
    out.append(" ".join("wörd🙂" * rng.randrange(1, 4) for _ in range(30_000)) + "\n")
    out += ["x" * 5000, " " * 5000, "é" * 3000]
    return out


def test_cuts_equal_re(spark):
    rows = [(i % 90 if i % 7 else None, t) for i, t in enumerate(odd_texts() * 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash")).withColumn("cut", F.lit(1)).withColumn("body", F.lit("b"))
    for rate, spm in ((50, 80), (100, 50), (0, 0)):
        out = infill.rearranged(d, rate, spm)
        want = sorted((filled(i, t, rate, spm) for i, t in rows), key=str)
        assert sorted((tuple(r) for r in out.collect()), key=str) == want
        back = out.select("doc_id", infill.restored(F.col("output"), F.col("form")))
        assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


def test_cuts_of_all_rows_and_of_nothing(docs, rows, nothing):
    assert sorted((tuple(r) for r in infill.rearranged(docs).collect()), key=str) == sorted((filled(r[0], r[1]) for r in rows), key=str)
    assert infill.rearranged(nothing).collect() == []


def test_fenwick_tree_equals_running_sums():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 8, 9, 100):
        counts = rng.integers(0, 4, n)
        tree, total = infill.Fenwick(counts), np.cumsum(counts)
        assert tree.before(np.arange(n + 1)).tolist() == [0, *total.tolist()]
        wanted = np.arange(1, total[-1] + 1)
        block, passed = tree.find(wanted)
        assert block.tolist() == np.searchsorted(total, wanted, side="left").tolist()
        assert passed.tolist() == (total[block] - counts[block]).tolist()


# ---------------------------------------------------------------- op13
def test_chain_equals_enumeration():
    rng = np.random.default_rng(3)
    sizes = [1, 4, 2, 3]
    at = np.concatenate([[0], np.cumsum(sizes)])
    scores, moves = rng.normal(size=at[-1]), rng.normal(size=(2, 2))
    got, pairs = toxicity.chain(scores, moves, at)
    want, expected = np.zeros(at[-1]), np.zeros((2, 2))
    for a, b in zip(at[:-1], at[1:]):
        weight = {y: np.exp(sum(scores[a + i] for i in range(b - a) if y[i]) + sum(moves[y[i], y[i + 1]] for i in range(b - a - 1))) for y in itertools.product((0, 1), repeat=b - a)}
        z = sum(weight.values())
        for y, w in weight.items():
            want[a:b] += np.array(y) * w / z
            for i in range(b - a - 1):
                expected[y[i], y[i + 1]] += w / z
    assert np.allclose(got, want) and np.allclose(pairs, expected)


BAD = ["vilest", "rotten", "grubby", "stinker"]


def talk(rng, n, bad=0):
    words = ["".join(rng.choice(["ba", "do", "ri", "lu", "ne", "sta", "mo"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    at = sorted(rng.sample(range(n), bad))
    for i in at:
        words[i] = rng.choice(BAD) + rng.choice(["", "", "s", "ly"])
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in words), at


def test_planted_words_are_found_in_unseen_documents(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        t, _ = talk(rng, rng.randrange(30, 120), rng.randrange(2, 6) if bad else 0)
        rows.append((i, t, "en", "s", len(t)))
        if i < 300:
            marks.append((i, 1, int(bad)))
    rows += [(5, rows[5][1], "en", "s", 1)] * 200  # a group of copies
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right = sum(out[i].predicted == (i % 5 == 0) for i in range(300, 400))
    assert right >= 97
    found = [rows[i][1][s.start : s.end].rstrip(".").lower() for i in range(300, 400) for s in out[i].spans]
    assert sum(any(b in f for b in BAD) for f in found) >= 0.95 * len(found) > 40
    assert all(0 <= r.score <= 1 for r in out.values())


def small_model():
    rng = random.Random(8)
    return toxicity.fit([(f"{talk(rng, 8)[0]} 🙂 {'stinker' if i % 2 else 'lovely'} ñu".encode(), i % 2) for i in range(120)])


def test_spans_are_code_points():
    model = small_model()
    text = "ñ🙂 x stinker y"
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    score, spans = toxicity.judge(model, data, np.array([0, len(data)]))
    assert [text[s:e] for s, e, _ in spans[0]] == ["stinker"] and score[0] > 0.5


def test_scores_of_odd_rows(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None), (900, 7)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    none = toxicity.train(nothing, labels)
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(nothing, none).collect() == []
    only = labels.filter("toxic = 1")
    assert {r.predicted for r in toxicity.score(docs, toxicity.train(docs, only)).collect()} == {1}


def test_a_very_long_text_is_scored_whole(spark):
    model = small_model()
    text = "word " * 200_000 + "stinker"
    (row,) = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [(s.start, s.end) for s in row.spans] == [(1_000_000, 1_000_007)]
