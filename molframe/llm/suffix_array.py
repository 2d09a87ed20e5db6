"""Suffix-array deduplication: bytes of strings that an earlier document holds are removed.

Suffixes are sorted in two stages. Those smaller than their successor are sorted directly; the others follow from one
scan over the buckets of first bytes, since such a suffix stands in its bucket as its successor stands in the order.
Common prefixes of neighbours in the order then tell which strings of `width` bytes are equal. The order is made per
bucket of `repeats.pieces`, so no task holds more than its share of the candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, portions, slices
from .repeats import Units, covered, distinct, first_texts, joined_pieces, repeat_spans, stretches


def big_endian(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, in sorting order; zeros follow the end."""
    w = np.zeros(len(text) + 8, dtype=np.uint64)
    w[: len(text)] = text
    for size in (1, 2, 4):
        w[:-size] = w[:-size] << np.uint64(8 * size) | w[size:]
    return w[: len(text)]


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Is the suffix smaller than the next one? Equal bytes are decided by the first different one after them."""
    n = len(text)
    out = np.zeros(n, dtype=bool)
    if n < 2:
        return out
    edge = np.flatnonzero(text[1:] != text[:-1])  # last place of each stretch of equal bytes, but for the last stretch
    rise = text[edge + 1] > text[edge]
    out[: edge[-1] + 1] = np.repeat(rise, np.diff(edge, prepend=-1)) if len(edge) else False
    return out


def sort_directly(packed: np.ndarray, suffixes: np.ndarray, depth: int, step: int) -> np.ndarray:
    """Suffixes in order of their first `depth` units; `packed` holds the `step` units from each place on in one number.
    After the first number only suffixes still tied are looked at."""
    pad = np.concatenate([packed, np.zeros(depth + step, dtype=np.uint64)])
    order = suffixes[np.argsort(pad[suffixes])]
    if len(order) < 2:
        return order
    word, group, open_ = pad[order], np.zeros(len(order), np.int64), np.arange(len(order))
    for d in range(step, depth + step, step):
        same = (word[1:] == word[:-1]) & (group[1:] == group[:-1])
        tied = np.zeros(len(open_), dtype=bool)
        tied[1:] |= same
        tied[:-1] |= same
        open_, group = open_[tied], np.cumsum(np.concatenate([[True], ~same]))[tied]
        if d >= depth or not len(open_):
            break
        word = pad[order[open_] + d]
        by = np.lexsort((word, group))
        order[open_], word = order[open_][by], word[by]
    return order


def two_stage(text: np.ndarray, w8: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of `text` in order of their first `depth` bytes; `w8` holds eight bytes from each place on."""
    n = len(text)
    small = smaller_than_next(text)
    direct = sort_directly(w8, np.flatnonzero(small), depth, 8)
    byte_of = text[direct]
    b_at = np.searchsorted(byte_of, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))  # nothing follows it, so it precedes all of its bucket
    buckets = []
    for c in range(256):
        induced = waiting[c]
        part = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        # a stretch of equal bytes before a smaller one: each place follows from the place after it
        layer, layers = part, [part]
        while len(layer):
            prev = layer - 1
            prev = prev[prev >= 0]
            layer = prev[(text[prev] == c) & ~small[prev]]
            layers.append(layer)
        bucket = np.concatenate([*layers, direct[b_at[c] : b_at[c + 1]]])
        buckets.append(bucket)
        prev = bucket - 1
        prev = prev[prev >= 0]
        prev = prev[(text[prev] > c) & ~small[prev]]
        if len(prev):
            by = text[prev]
            order = np.argsort(by, kind="stable")
            prev, by = prev[order], by[order]
            cuts = np.flatnonzero(np.diff(by)) + 1
            for x in np.split(prev, cuts):
                waiting[text[x[0]]].append(x)
    return np.concatenate(buckets)


def equal_windows(text: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places `starts` (a mask) in suffix order, and for each whether it shares `width` bytes with the one before."""
    w8 = big_endian(text)
    order = two_stage(text, w8, width)
    order = order[starts[order]]
    a, b = order[1:], order[:-1]
    same = np.ones(len(a), dtype=bool)
    at = np.arange(len(a))
    for d in [*range(0, width - 7, 8), max(0, width - 8)] if width >= 8 else []:
        hit = w8[a[at] + d] == w8[b[at] + d]
        same[at[~hit]] = False
        at = at[hit]
    if width < 8:
        same = w8[a] >> np.uint64(64 - 8 * width) == w8[b] >> np.uint64(64 - 8 * width)
    return order, np.concatenate([np.zeros(min(1, len(order)), dtype=bool), same])


def _judge(width: int):
    """The stretches of a bucket's pieces whose windows a document before theirs holds too."""

    def work(rows: pa.Table) -> pa.Table:
        doc, pos = rows.column("doc_id").to_numpy(), rows.column("pos").to_numpy().astype(np.int64)
        of, texts = distinct(rows.column("piece").to_pylist())
        first = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(first, of, doc)
        size = np.array([len(t) for t in texts])
        # each piece closed by a byte that no UTF-8 text holds
        text, begin = joined_pieces(np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum(size)]), 255)
        windows = size - width + 1
        place, _ = slices(begin[:-1], windows)
        is_start = np.zeros(len(text), dtype=bool)
        is_start[place] = True
        owner = np.zeros(len(text), dtype=np.int32)
        owner[place] = np.repeat(np.arange(len(texts)), windows)
        order, same = equal_windows(text, is_start, width)
        head = np.flatnonzero(~same)
        holder = first[owner[order]]
        earliest = np.repeat(np.minimum.reduceat(holder, head), np.diff(head, append=len(order)))
        hit = np.zeros(len(text), dtype=bool)
        hit[order[holder > earliest]] = True
        later = np.flatnonzero(doc > first[of])
        own = np.flatnonzero(doc == first[of])
        row, at, n = stretches(hit, begin[of[own]], windows[of[own]])
        out_doc, out_pos = np.concatenate([doc[later], doc[own][row]]), np.concatenate([pos[later], pos[own][row] + at])
        length = np.concatenate([size[of[later]], n + width - 1])
        return pa.table({"doc_id": pa.array(out_doc), "start": pa.array(out_pos), "length": pa.array(length)})

    return work


def dedup(docs: DataFrame, width: int = 50, k: int = 24, hot: int = 50_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) for every document.

    A byte goes if it lies in a string of `width` bytes that also starts in a document with a smaller doc_id; strings are
    judged on the input. `kept` is what is left, as bytes (a cut may fall inside a character). Null and empty texts stay
    empty; texts shorter than `width` lose nothing; of rows with one text all but that with the smallest doc_id lose
    everything. A doc_id names one text: rows that repeat it with that text all give the same result. Rows without
    doc_id are returned whole. Other columns of `docs` are not read."""
    units = Units(width, k, False)
    reps, others = first_texts(docs, units)
    spans = repeat_spans(reps, units, True, _judge(width), hot)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            data, at = flat(b.column("body"))
            starts, lengths = b.column("starts"), b.column("lengths")
            s, m = starts.flatten().to_numpy(zero_copy_only=False), lengths.flatten().to_numpy(zero_copy_only=False)
            spans_at = np.concatenate([[0], np.cumsum(starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            gone = covered(spans_at, s, s + m, at)
            count = np.concatenate([[0], np.cumsum(gone)])
            left = data[~gone].tobytes()
            left_at = (at - count[at]).tolist()
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            head = at[:-1][at[:-1] < len(gone)]
            begins[head] = gone[head]
            n_spans = np.concatenate([[0], np.cumsum(begins)])
            kept = [left[x:y] for x, y in zip(left_at[:-1], left_at[1:], strict=True)]
            digest = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), pa.array(np.diff(count[at])), pa.array(np.diff(n_spans[at])), pa.array(kept, pa.binary()), pa.array(digest)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    rows = reps.select("doc_id", "body").join(spans, "doc_id", "left")
    stripped = rows.mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    gone, left = F.col("gone"), F.col("short").cast("binary")
    copies = others.select("doc_id", F.col("size").alias("n_bytes"), F.when(gone, F.col("size")).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"), left.alias("kept"), F.sha2(left, 256).alias("kept_sha256"))
    return stripped.unionByName(copies)
