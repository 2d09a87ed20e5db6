"""Where texts may repeat: the part that suffix-array and suffix-tree deduplication share.

A window is `width` units (bytes or words) in a row. To find equal windows without sending every suffix through a
shuffle, each window is given a key: the least hash of the k-grams in it. Equal windows have equal keys, and neighbours
mostly share theirs, so a run of windows with one key is sent as one piece of text. Copies of a whole text are set apart
first. Before any text is sent, the keys alone are counted (five bytes each, in packed blocks); pieces are cut only for
keys that occur again. A key met very often is extended from k units to the whole window, so that no single key gathers
an unbounded bucket: such windows are compared by a hash of 128 bits. These steps choose where windows meet and never
which windows count: two equal windows always come to the same bucket, and buckets compare the texts themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, as_binary, by_key, cut, flat, parts, portions, raw, release, slices

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
BYTE_HASH = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
SLICE = 1 << 17
FLUSH = 500_000


class Units(NamedTuple):
    """How texts are read: units in a window, units in a k-gram, and whether units are words or bytes."""

    width: int
    k: int
    words: bool


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= M3
    x ^= x >> np.uint64(32)
    return x


def _grams(unit: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k units from each place on, by doubling."""
    by, out, size, done, mult = unit, None, 1, 0, M1
    while True:
        if k & size:
            n = len(unit) - done - size + 1
            out = by[:n].copy() if out is None else out[:n] * mult + by[done : done + n]
            done += size
        if done == k:
            return _mix(out)
        by = by[:-size] * mult + by[size:]
        mult = np.uint64((int(mult) * int(mult) * int(M2) | 1) & (2**64 - 1))
        size *= 2


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of the w values from each place on."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == w else np.minimum(x[: len(x) - (w - size)], x[w - size :])


def runs(unit: np.ndarray, ends: np.ndarray, width: int, k: int, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key: first window, windows, key. `ends`: where texts end among the units.
    `apart`: a run ends where another k-gram of the same hash takes over, so two equal windows never share a run."""
    n = len(unit) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = _grams(unit, k)
    least = _least(grams, width - k + 1)
    ok = np.ones(n, dtype=bool)
    for e in ends.tolist():
        ok[max(0, e - width + 1) : e] = False
    turn = np.empty(n, dtype=bool)
    turn[0] = True
    np.not_equal(least[1:], least[:-1], out=turn[1:])
    turn[1:] |= ok[1:] != ok[:-1]
    if apart:
        turn[1:] |= grams[: n - 1] == least[:-1]
    first = np.flatnonzero(turn)
    length = np.diff(first, append=n)
    good = ok[first]
    return first[good], length[good], least[first[good]]


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of the batch, and where each text's words begin (one more for the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    in_word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = in_word[:-1]
    edge = at[1:-1][at[1:-1] < len(data)]
    before[edge] = False  # a text's first byte begins a word whatever the text before ended with
    starts = np.flatnonzero(in_word & ~before)
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = in_word[1:]
    last = at[1:-1][at[1:-1] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(in_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


_P = 1_099_511_628_211
_STEP = 1 << 20


def _powers() -> tuple[np.ndarray, np.ndarray]:
    inv = pow(_P, -1, 1 << 64)
    up, down = np.full(_STEP, _P, dtype=np.uint64), np.full(_STEP, inv, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_UP: list[np.ndarray] = []


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums over stretches of the batch."""
    if not _UP:
        _UP.extend(_powers())
    up, down = _UP
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + _STEP - 1, side="right"))
        if j <= i:  # one word longer than a stretch
            out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
            i += 1
            continue
        lo, hi = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(BYTE_HASH[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * M2
        i = j
    return _mix(out)


def batch_runs(data: np.ndarray, at: np.ndarray, units: Units) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of a batch of texts: text, first window (unit of the batch), windows, key."""
    if units.words:
        starts, ends, at = words_of(data, at)
        whole = word_hashes(data, starts, ends)
    n = int(at[-1])
    for s in range(0, n, SLICE):
        e = min(n, s + SLICE + units.width - 1)
        unit = whole[s:e] if units.words else BYTE_HASH[data[s:e]]
        a, b = np.searchsorted(at, [s, e], side="right")
        first, length, key = runs(unit, at[a:b] - s, units.width, units.k, units.words)
        yield np.searchsorted(at, first + s, side="right") - 1, first + s, length, key


def code_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 40 bits of a key in one number, by which the counting and the cutting step name it."""
    return ((key >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16) << np.uint64(40) | key & np.uint64((1 << 40) - 1)).astype(np.int64)


def _pack(code: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of bucket, keys and documents; documents as differences."""
    bucket = code >> 40
    order = np.argsort(bucket, kind="stable")
    code, doc, bucket = code[order], doc[order], bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    squeeze = zstandard.ZstdCompressor(level=1)
    keys = np.ascontiguousarray(code).view(np.uint8).reshape(-1, 8)[:, :5]
    rows = [(int(bucket[a]), keys[a:b].tobytes(), squeeze.compress(np.diff(doc[a:b], prepend=0).tobytes())) for a, b in zip(first, [*first[1:], len(code)], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "keys", "docs"])


def first_texts(docs: DataFrame, units: Units) -> tuple[DataFrame, DataFrame]:
    """Rows that are the first with their text (doc_id, body, times), bucketed by doc_id, and all other rows
    (doc_id, size, gone, short): `size` in units, `gone` for a copy with a window, else `short` is the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)) if units.words else F.octet_length(text)
    rows = docs.select("doc_id", F.sha2(raw(), 256).alias("digest"), size.cast("long").alias("size"), "text")
    gone = F.col("doc_id").isNotNull() & (F.col("size") >= units.width)
    rows = rows.select("doc_id", "digest", "size", gone.alias("gone"), F.when(gone, "").otherwise(F.coalesce("text", F.lit(""))).alias("short"))
    firsts = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("doc_id").alias("times")))
    reps = by_key(docs.select("doc_id", raw().alias("body")).join(firsts.select("doc_id", "times"), "doc_id"), "doc_id")
    known = rows.join(firsts.select("digest", F.col("doc_id").alias("first")), "digest")
    return reps, known.filter("doc_id is null or doc_id != first").select("doc_id", "size", "gone", "short")


def repeated_keys(reps: DataFrame, units: Units, buckets: int, across: bool, hot: int) -> DataFrame:
    """(doc_id, code): keys of a text that occur again; `across`: in another text. Texts with copies name all their keys,
    unless `across`. A key in more than `hot` places is returned as -code - 1. A table in the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in portions(batches):
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            data, at = flat(b.column("body"))
            for text, _, _, key in batch_runs(data, at, units):
                held.append((code_of(key, buckets), ids[text]))
                n += len(key)
                if n >= FLUSH:
                    yield from _pack(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield from _pack(*map(np.concatenate, zip(*held, strict=True)))

    def again(blocks: pa.Table) -> pa.Table:
        low, doc = [], []
        for keys, ids in zip(blocks.column("keys").to_pylist(), blocks.column("docs").to_pylist(), strict=True):
            five = np.zeros((len(keys) // 5, 8), dtype=np.uint8)
            five[:, :5] = np.frombuffer(keys, dtype=np.uint8).reshape(-1, 5)
            low.append(five.view(np.int64).ravel())
            doc.append(np.cumsum(np.frombuffer(zstandard.decompress(ids), dtype=np.int64)))
        low, doc = np.concatenate(low), np.concatenate(doc)
        order = np.argsort(low)
        low, doc = low[order], doc[order]
        first = np.flatnonzero(np.diff(low, prepend=-1))
        size = np.diff(first, append=len(low))
        keep = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if across else size > 1
        code = low | (np.int64(blocks.column("bucket")[0].as_py()) << 40)
        code = np.where(np.repeat(size > hot, size), -code - 1, code)
        mask = np.repeat(keep, size)
        return pa.table({"doc_id": pa.array(doc[mask]), "code": pa.array(code[mask])})

    packed = reps.select("doc_id", "body").mapInArrow(count, "bucket int, keys binary, docs binary")
    return cut(packed.groupBy("bucket").applyInArrow(again, "doc_id long, code long"))


def _cutter(units: Units, buckets: int, hot: bool):
    """Texts with the codes of their repeated keys in, pieces out; `hot`: windows of hot keys instead, by a hash of 128 bits."""
    width = units.width

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            data, at = flat(b.column("body"))
            codes = np.unique(b.column("codes").flatten().to_numpy(zero_copy_only=False))
            if units.words:
                w_start, w_end, w_at = words_of(data, at)
                # words joined by one space: copied word by word into one buffer
                index, joined_at = slices(w_start, w_end - w_start + 1)
                joined = data[np.minimum(index, max(len(data) - 1, 0))] if len(data) else data
                joined[joined_at[1:] - 1] = 32
                del index
            for t, f, m, key in batch_runs(data, at, units):
                code = code_of(key, buckets)
                take = np.isin(code, codes)
                t, f, m, code = t[take], f[take], m[take], code[take]
                if not len(t):
                    continue
                if hot:
                    f, _ = slices(f, m)
                    t, m = np.repeat(t, m), np.ones(m.sum(), np.int64)
                if units.words:
                    lo, hi, pos, body = joined_at[f], joined_at[f + m + width - 1] - 1, f - w_at[t], joined
                else:
                    lo, hi, pos, body = f, f + m + width - 1, f - at[t], data
                index, out_at = slices(lo, hi - lo)
                text = body[index].tobytes()
                place = pa.array(pos.astype(np.int32))
                if hot:
                    spots = out_at.tolist()
                    digest = [xxhash.xxh3_128_digest(text[x:y]) for x, y in zip(spots[:-1], spots[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(ids[t]), place], names=["window", "doc_id", "pos"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(code), as_binary(text, out_at), pa.array(ids[t]), place], names=["key", "piece", "doc_id", "pos"])

    return work


def repeat_spans(reps: DataFrame, units: Units, across: bool, judge: Callable[[pa.Table], pa.Table], hot: int) -> DataFrame:
    """(doc_id, starts, lengths): stretches of units, in windows that repeat. A table in the shared folder.

    `judge` takes one bucket of pieces (key, piece, doc_id, pos) and returns such stretches (doc_id, start, length).
    Windows of keys in more than `hot` places are not sent as text: their hashes are combined before the shuffle and
    joined back, which Spark can split at any size."""
    buckets = min(1 << 16, max(16, 4 * parts(reps.sparkSession)))
    keys = repeated_keys(reps, units, buckets, across, hot)
    release(reps.sparkSession)

    def with_codes(codes: DataFrame) -> DataFrame:
        # dealt out before the lists are made: half-made lists would be larger than their numbers
        lists = codes.repartition(parts(reps.sparkSession), "doc_id").groupBy("doc_id").agg(F.collect_list("code").alias("codes"))
        return reps.select("doc_id", "body").join(lists, "doc_id")

    cold = with_codes(keys.filter("code >= 0")).mapInArrow(_cutter(units, buckets, False), "key long, piece binary, doc_id long, pos int")
    # a bucket is held and sorted whole, so there are many more of them than tasks
    spans = cold.groupBy(F.pmod(F.xxhash64("key"), F.lit(16 * parts(reps.sparkSession))).alias("bucket")).applyInArrow(judge, "doc_id long, start long, length long")
    often = keys.filter("code < 0").select("doc_id", (-F.col("code") - 1).alias("code"))
    windows = cut(with_codes(often).mapInArrow(_cutter(units, buckets, True), "window binary, doc_id long, pos int"))
    seen = windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.count("*").alias("times"))
    again = windows.join(seen, "window").filter("doc_id > first" if across else "times > 1").select("doc_id", F.col("pos").cast("long").alias("start"), F.lit(units.width).cast("long").alias("length"))
    found = cut(spans.unionByName(again))
    release(reps.sparkSession)
    return found.repartition(parts(reps.sparkSession), "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("spans")).select("doc_id", F.col("spans.start").alias("starts"), F.col("spans.length").alias("lengths"))


def joined_pieces(data: np.ndarray, at: np.ndarray, close: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces one after the other, each closed by the byte `close`, and where each begins (one more for the end)."""
    n = len(at) - 1
    text = np.full(len(data) + n, close, dtype=np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at))] = data
    return text, at + np.arange(n + 1)


def distinct(pieces: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The number of each piece's text, and the different texts by number."""
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(p, len(number)) for p in pieces], dtype=np.int64)
    return of, list(number)


def stretches(hit: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of set windows, row by row: row, first window in the row, windows. Row i has windows[i] flags of `hit`
    from starts[i] on."""
    index, row_at = slices(starts, windows)
    on = np.zeros(len(index) + 1, dtype=bool)
    on[:-1] = hit[index]
    new_row = np.zeros(len(on), dtype=bool)
    new_row[row_at] = True
    before = np.concatenate([[False], on[:-1]])
    begins = np.flatnonzero(on & (~before | new_row))
    stops = np.flatnonzero(before & (~on | new_row))
    row = np.searchsorted(row_at, begins, side="right") - 1
    return row, begins - row_at[row], stops - begins


def covered(spans_at: np.ndarray, starts: np.ndarray, ends: np.ndarray, units_at: np.ndarray) -> np.ndarray:
    """Mask of the units of a batch that lie in a span. Spans of text i are those from spans_at[i] to spans_at[i + 1]."""
    delta = np.zeros(int(units_at[-1]) + 1, dtype=np.int32)
    base, stop = (np.repeat(x, np.diff(spans_at)) for x in (units_at[:-1], units_at[1:]))
    np.add.at(delta, np.minimum(base + starts, stop), 1)
    np.add.at(delta, np.minimum(base + ends, stop), -1)
    return np.cumsum(delta[:-1]) > 0
