"""op2 and op3 against brute force, and the two sorts inside them."""

import collections
import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from molframe.llm import suffix_array, suffix_tree
from molframe.llm.repeats import word_hashes, words_of


def brute_bytes(rows, width):
    texts = sorted({(i, (t or "").encode()) for i, t, *_ in rows})
    first = {}
    for i, t in texts:
        for p in range(len(t) - width + 1):
            first.setdefault(t[p : p + width], i)
    out = {}
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - width + 1):
            if first[t[p : p + width]] < i:
                gone[p : p + width] = [True] * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out[i] = (len(t), sum(gone), spans, kept, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, width):
    texts = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    seen = collections.Counter(tuple(w[p : p + width]) for _, w in texts for p in range(len(w) - width + 1))
    out = {}
    for i, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if seen[tuple(w[p : p + width])] > 1:
                gone[p : p + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), kept.decode(), hashlib.sha256(kept).hexdigest())
    return out


def test_bytes_equal_brute_force(docs, rows):
    got = suffix_array.dedup(docs, width=50).collect()
    want = brute_bytes(rows, 50)
    assert len(got) == len(rows)
    assert {r[0]: (*r[1:4], bytes(r[4]), r[5]) for r in got} == want
    assert sum(w[1] for w in want.values()) > 1000


def test_bytes_with_every_key_hot(docs, rows):
    got = suffix_array.dedup(docs, width=50, hot=1).collect()
    assert {r[0]: (*r[1:4], bytes(r[4]), r[5]) for r in got} == brute_bytes(rows, 50)


def test_words_equal_brute_force(docs, rows):
    want = brute_words(rows, 35)
    for hot in (1000, 1):
        got = suffix_tree.dedup(docs, width=35, hot=hot).collect()
        assert len(got) == len(rows)
        assert {r[0]: tuple(r[1:]) for r in got} == want
    assert want[31][1] == 120  # repeats within one text count


def test_no_rows(nothing):
    assert suffix_array.dedup(nothing).count() == 0
    assert suffix_tree.dedup(nothing).count() == 0


def test_row_without_id_is_whole(spark, rows):
    some = spark.createDataFrame([(1, rows[0][1]), (None, rows[0][1])], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffix_array.dedup(some).collect()} == {1: 0, None: 0}
    assert {r.doc_id: r.n_removed for r in suffix_tree.dedup(some).collect()} == {1: 0, None: 0}


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=120).map(lambda b: bytes(x % 3 + 97 for x in b)), st.integers(1, 12))
def test_two_stage_sorts_to_the_depth(text, depth):
    x = np.frombuffer(text + b"\xff", dtype=np.uint8)
    order = suffix_array.two_stage(x, suffix_array.big_endian(x), depth).tolist()
    assert sorted(order) == list(range(len(x)))
    cut = [bytes(x[i : i + depth]) for i in order]
    assert cut == sorted(cut)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=80), st.integers(1, 9), st.integers(1, 20))
def test_subtrees_find_repeats(words, width, most):
    w = np.array(words)
    starts = np.arange(max(0, len(w) - width + 1))
    packed = np.append(w, 0).astype(np.uint64)
    packed = packed[:-1] << np.uint64(32) | packed[1:]
    hit = np.zeros(len(w), dtype=bool)
    met = []
    for suffixes, depth in suffix_tree.prefix_groups(w, starts, width, most):
        met += suffixes.tolist()
        assert len(suffixes) <= most or depth >= width
        leaves, first, size = suffix_tree.deep_nodes(w, packed, suffixes, depth, width)
        for f, s in zip(first, size):
            hit[leaves[f : f + s]] = True
    assert sorted(met) == starts.tolist()
    seen = collections.Counter(tuple(words[p : p + width]) for p in starts)
    assert hit.tolist() == [p in starts and seen[tuple(words[p : p + width])] > 1 for p in range(len(w))]


def test_word_hash_depends_on_the_word_alone():
    texts = [b"some words and", b"words  again\nsome", b"", b"and"]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    starts, ends, of = words_of(data, at)
    words = [bytes(data[s:e]) for s, e in zip(starts, ends)]
    assert words == [w for t in texts for w in t.split()]
    assert np.diff(of).tolist() == [3, 3, 0, 1]
    code = dict(zip(words, word_hashes(data, starts, ends).tolist()))
    assert len(set(code.values())) == 4
    assert [code[w] for w in words] == word_hashes(data, starts, ends).tolist()
