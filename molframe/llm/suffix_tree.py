"""Substring deduplication by suffix trees: words inside passages that occur more than once are removed.

The suffixes of a bucket of `repeats.pieces` are split by prefixes of variable length: a prefix is made one word longer
for as long as more suffixes share it than one subtree may hold. Each subtree is built from its suffixes in order and
their common prefixes; inner nodes as deep as a window are the repeats, and the leaves below them the places."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP, flat, portions, slices
from .repeats import Units, covered, distinct, first_texts, repeat_spans, stretches, words_of
from .suffix_array import sort_directly

SUBTREE = 1 << 16


def prefix_groups(words: np.ndarray, starts: np.ndarray, width: int, most: int = SUBTREE) -> Iterator[tuple[np.ndarray, int]]:
    """Suffixes that share a prefix, and its length: `most` at most, unless the prefix is `width` words long. Neighbouring
    small groups are given together, under the prefix that they still share."""
    todo = [(starts, 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) <= most or depth >= width:
            yield group, depth
            continue
        word = words[group + depth]
        order = np.argsort(word, kind="stable")
        group, word = group[order], word[order]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        held: list[np.ndarray] = []
        for sub in np.split(group, first[1:]):
            if len(sub) > most:
                todo.append((sub, depth + 1))
                continue
            if held and sum(map(len, held)) + len(sub) > most:
                yield np.concatenate(held), depth
                held = []
            held.append(sub)
        if held:
            yield np.concatenate(held), depth


def deep_nodes(words: np.ndarray, packed: np.ndarray, suffixes: np.ndarray, depth: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of one subtree in order, and the first leaf and leaf count of each inner node at least `width` words deep.
    The suffixes share their first `depth` words. Below `width` words the tree is not told apart."""
    leaves = sort_directly(packed[depth:], suffixes, width - depth, 2) if depth < width else suffixes
    a, b = leaves[1:], leaves[:-1]
    common = np.full(len(a), width)
    at = np.arange(len(a))
    for d in range(depth, width):
        hit = words[a[at] + d] == words[b[at] + d]
        common[at[~hit]] = d
        at = at[hit]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(leaves)), dtype=bool), common < width]))
    size = np.diff(first, append=len(leaves))
    return leaves, first[size > 1], size[size > 1]


def repeated(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Mask over `words`: does the window that starts here (one of `starts`) also start at another place of `starts`?"""
    packed = np.append(words, 0).astype(np.uint64)
    packed = packed[:-1] << np.uint64(32) | packed[1:]
    out = np.zeros(len(words), dtype=bool)
    for suffixes, depth in prefix_groups(words, starts, width):
        leaves, first, size = deep_nodes(words, packed, suffixes, depth, width)
        index, _ = slices(first, size)
        out[leaves[index]] = True
    return out


def _judge(width: int):
    """The stretches of a bucket's pieces whose windows occur again."""

    def work(rows: pa.Table) -> pa.Table:
        doc, pos = rows.column("doc_id").to_numpy(), rows.column("pos").to_numpy().astype(np.int64)
        of, texts = distinct(rows.column("piece").to_pylist())
        words = pd.factorize(np.array(b" ".join(texts).split(), dtype=object))[0] + 1
        n_words = np.array([t.count(b" ") + 1 for t in texts])
        begin, windows = np.cumsum(n_words) - n_words, n_words - width + 1
        hit = repeated(words, slices(begin, windows)[0], width)
        index, _ = slices(begin, np.where(np.bincount(of) > 1, windows, 0))
        hit[index] = True
        row, at, n = stretches(hit, begin[of], windows[of])
        return pa.table({"doc_id": pa.array(doc[row]), "start": pa.array(pos[row] + at), "length": pa.array(n + width - 1)})

    return work


def dedup(docs: DataFrame, width: int = 35, k: int = 10, hot: int = 50_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) for every document.

    A word goes if it lies in a window of `width` words whose words also start at any other place, in this document or
    another; windows are judged on the input. `kept` is what is left, joined by one space. Null and empty texts have no
    words; texts of fewer than `width` words lose nothing; of rows with one text each loses all. A doc_id names one text.
    Rows without doc_id are returned whole. Other columns of `docs` are not read."""
    units = Units(width, k, True)
    reps, others = first_texts(docs, units)
    spans = repeat_spans(reps, units, False, _judge(width), hot)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            data, at = flat(b.column("body"))
            w_start, w_end, w_at = words_of(data, at)
            starts, lengths = b.column("starts"), b.column("lengths")
            s, m = starts.flatten().to_numpy(zero_copy_only=False), lengths.flatten().to_numpy(zero_copy_only=False)
            spans_at = np.concatenate([[0], np.cumsum(starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            gone = covered(spans_at, s, s + m, w_at)
            # a text with copies, if it has a window
            n = np.diff(w_at)
            whole = (b.column("times").to_numpy(zero_copy_only=False) > 1) & (n >= width)
            gone |= np.repeat(whole, n)
            count = np.concatenate([[0], np.cumsum(gone)])
            index, word_at = slices(w_start[~gone], (w_end - w_start + 1)[~gone])
            left = data[np.minimum(index, len(data) - 1)] if len(index) else np.zeros(0, np.uint8)
            left[word_at[1:] - 1] = 32
            left_at = word_at[w_at - count[w_at]].tolist()
            left = left.tobytes()
            kept = [left[x : max(x, y - 1)].decode("utf-8", "replace") for x, y in zip(left_at[:-1], left_at[1:], strict=True)]
            digest = [hashlib.sha256(left[x : max(x, y - 1)]).hexdigest() for x, y in zip(left_at[:-1], left_at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(w_at)), pa.array(np.diff(count[w_at])), pa.array(kept), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    schema = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
    firsts = reps.select("doc_id", "body", "times").join(spans, "doc_id", "left").mapInArrow(strip, schema)
    kept = F.trim(F.regexp_replace("short", GAP, " "))
    copies = others.select("doc_id", F.col("size").alias("n_words"), F.when(F.col("gone"), F.col("size")).otherwise(0).alias("n_removed"), kept.alias("kept"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
    return firsts.unionByName(copies)
