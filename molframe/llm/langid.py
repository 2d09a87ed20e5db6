"""Language identification of words and documents by a linear-chain conditional random field.

Each word is labelled with a language. A word's score for a language sums learned weights of its affixes (first and last
one to four bytes) and inner byte trigrams, and its log-odds in a lexicon counted over all labelled texts; transitions
between neighbouring words' languages are learned too, so a text may switch. Forward-backward gives each word's
marginals; a document's language is the one with the largest mean marginal, which is its score.

Weights are fitted on a bounded sample (SAMPLE documents a language, SAMPLE_CHARS characters each), joined from pieces of
several documents so that switches occur. The lexicon covers all labelled texts; prediction reads whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import flat, packed, portions, raw
from .repeats import word_hashes

SAMPLE, SAMPLE_CHARS = 150, 1500
BITS = 17
SLOTS = 1 << BITS
BLOCKS = 64
AFFIXES = 4
UNKNOWN = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # SLOTS x languages
    lexicon: np.ndarray  # SLOTS x languages, log-odds
    scale: float
    moves: np.ndarray  # languages x languages, scores of a change
    first: np.ndarray


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in small letters; other bytes as they are."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][latin] += 32
    return out


def letter_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of letters (a-z, or bytes above 127), and where each text's runs begin."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ((data >= 97) & (data <= 122)) | (data > 127)
    border = at[1:-1]
    first, last = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    inner = border[(border > 0) & (border < len(data))]
    first[inner] |= inside[inner + 1]
    last[inner] |= inside[inner]
    starts, ends = np.flatnonzero(first[:-1]), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, at)


def _slot(value: np.ndarray, kind: int) -> np.ndarray:
    return ((value + np.uint64(kind << 40)) * _ODD >> np.uint64(64 - BITS)).astype(np.int64)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Affix slots (words x 2 * AFFIXES, -1 for none), trigram slots, and the word of each trigram."""
    pad = np.concatenate([np.zeros(AFFIXES, np.uint64), data.astype(np.uint64), np.zeros(AFFIXES, np.uint64)])
    n = ends - starts
    affix = np.full((len(starts), 2 * AFFIXES), -1, dtype=np.int64)
    head, tail = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for i in range(AFFIXES):
        head = head << np.uint64(8) | pad[starts + AFFIXES + i]
        tail = tail | pad[ends + AFFIXES - 1 - i] << np.uint64(8 * i)
        ok = n > i
        affix[ok, i] = _slot(head[ok], 1 + i)
        affix[ok, AFFIXES + i] = _slot(tail[ok], 9 + i)
    many = np.maximum(n - 2, 0)
    word = np.repeat(np.arange(len(starts)), many)
    begin = np.cumsum(many) - many
    place = np.arange(len(word)) - begin[word] + starts[word] + AFFIXES
    tri = pad[place] << np.uint64(16) | pad[place + 1] << np.uint64(8) | pad[place + 2]
    return affix, _slot(tri, 20), word


def emissions(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Score of each word for each language."""
    out = np.zeros((len(starts), len(model.langs)), dtype=np.float32)
    if not len(starts):
        return out
    affix, tri, word = features(data, starts, ends)
    table = np.vstack([model.weights, np.zeros((1, len(model.langs)), np.float32)])
    for i in range(affix.shape[1]):
        out += table[affix[:, i]]
    many = np.bincount(word, minlength=len(starts))
    full = np.flatnonzero(many)
    if len(full):
        out[full] += np.add.reduceat(table[tri], (np.cumsum(many) - many)[full], axis=0)
    return out + np.float32(model.scale) * model.lexicon[_slot(word_hashes(data, starts, ends), 0)]


def marginals(model: Model, scores: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Sum of the word marginals of each text by forward-backward, all texts step by step together; with `keep` each word's."""
    n, langs = np.diff(at), len(model.langs)
    total = np.zeros((len(n), langs))
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    if not len(order):
        return total, np.zeros((0, langs)) if keep else None
    begin, size = at[:-1][order], n[order]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-12
    move = np.exp(model.moves - model.moves.max())
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts longer than t words
    alpha = np.empty_like(e)
    a = np.exp(model.first - model.first.max()) * e[begin]
    a /= a.sum(axis=1, keepdims=True)
    alpha[begin] = a
    for t in range(1, int(size[0])):
        m = active[t]
        i = begin[:m] + t
        a = (a[:m] @ move) * e[i]
        a /= a.sum(axis=1, keepdims=True)
        alpha[i] = a
    b = np.ones((0, langs))
    back = move.T.copy()
    each = np.empty_like(e) if keep else None
    acc = np.zeros((len(order), langs))
    for t in range(int(size[0]) - 1, -1, -1):
        m = active[t]
        if len(b):
            b = (b * e[begin[: len(b)] + t + 1]) @ back
            b /= b.sum(axis=1, keepdims=True)
        if m > len(b):
            b = np.concatenate([b, np.full((m - len(b), langs), 1.0 / langs)])
        i = begin[:m] + t
        p = alpha[i] * b
        p /= p.sum(axis=1, keepdims=True)
        acc[:m] += p
        if keep:
            each[i] = p
    total[order] = acc
    return total, each


def lexicon(rows: DataFrame, langs: list[str]) -> np.ndarray:
    """Log-odds of each word slot for each language, counted over all `rows` (body, lang)."""
    number = {x: i for i, x in enumerate(langs)}
    width = SLOTS // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS * len(langs), dtype=np.int64)
        for b in portions(batches, most=1 << 20):
            data, at = flat(b.column("body"))
            data = lowered(data)
            starts, ends, w_at = letter_runs(data, at)
            lang = np.array([number[x] for x in b.column("lang").to_pylist()], dtype=np.int64)
            held += np.bincount(_slot(word_hashes(data, starts, ends), 0) * len(langs) + np.repeat(lang, np.diff(w_at)), minlength=len(held))
        if held.any():
            part = held.reshape(BLOCKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in part], pa.binary())], names=["block", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in t.column("counts").to_pylist())
        return pa.table({"block": t.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    counted = rows.select("body", "lang").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary")
    counts = np.zeros((BLOCKS, width * len(langs)), dtype=np.int64)
    for block, data in counted.collect():  # BLOCKS rows of fixed size
        counts[block] = np.frombuffer(data, dtype=np.int64)
    counts = counts.reshape(SLOTS, len(langs)).astype(float)
    share = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * SLOTS)
    odds = np.log(share)
    return np.clip(odds - odds.mean(axis=1, keepdims=True), -6, 6).astype(np.float32)


def fit(texts: list[tuple[bytes, str]], langs: list[str], lex: np.ndarray, rounds: int = 60, rate: float = 0.3, length: int = 48) -> Model:
    """A model fitted to labelled texts by gradient ascent on the likelihood of label sequences. Sequences of `length`
    words are put together from pieces of 4 to 24 words of different texts."""
    rng = np.random.default_rng(9)
    count = len(langs)
    texts = sorted(texts)
    body = [lowered(np.frombuffer(t, dtype=np.uint8)) for t, _ in texts]
    data = np.concatenate([*body, np.zeros(0, np.uint8)])
    at = np.concatenate([[0], np.cumsum([len(b) for b in body])]).astype(np.int64)
    starts, ends, w_at = letter_runs(data, at)
    label = np.repeat(np.array([langs.index(x) for _, x in texts], dtype=np.int64), np.diff(w_at))
    model = Model(langs, np.zeros((SLOTS, count), np.float32), lex, 0.3, np.eye(count) * 2.0, np.zeros(count))
    parts = []
    for s, e in zip(w_at[:-1].tolist(), w_at[1:].tolist(), strict=True):
        while s < e:
            m = int(rng.integers(4, 25))
            parts.append(np.arange(s, min(e, s + m)))
            s += m
    if not parts:
        return model
    word = np.concatenate([parts[i] for i in rng.permutation(len(parts))])
    word = np.concatenate([word, word[: -len(word) % length]])
    word = np.resize(word, max(1, len(word) // length) * length).reshape(-1, length)
    gold = label[word]
    affix, tri, owner = features(data, starts, ends)
    affix_word, affix_slot = np.repeat(np.arange(len(starts)), affix.shape[1])[affix.ravel() >= 0], affix.ravel()[affix.ravel() >= 0]
    slot, of = np.concatenate([affix_slot, tri]).astype(np.int32), np.concatenate([affix_word, owner]).astype(np.int32)
    del affix, tri, owner, affix_word, affix_slot
    lex_of = lex[_slot(word_hashes(data, starts, ends), 0)]
    weights, scale, moves, first = model.weights.astype(float), model.scale, model.moves.copy(), model.first.copy()
    seen = [np.full_like(weights, 1e-6), 1e-6, np.full_like(moves, 1e-6), np.full_like(first, 1e-6)]
    rows = len(word)
    for _ in range(rounds):
        score = np.stack([np.bincount(of, weights[slot, y], minlength=len(starts)) for y in range(count)], axis=1) + scale * lex_of
        e = np.exp(score - score.max(axis=1, keepdims=True))[word]
        move = np.exp(moves - moves.max())
        alpha, beta = np.empty_like(e), np.ones_like(e)
        a = np.exp(first - first.max()) * e[:, 0]
        for t in range(length):
            a = a if t == 0 else (a @ move) * e[:, t]
            a /= a.sum(axis=1, keepdims=True)
            alpha[:, t] = a
        for t in range(length - 2, -1, -1):
            b = (beta[:, t + 1] * e[:, t + 1]) @ move.T
            beta[:, t] = b / b.sum(axis=1, keepdims=True)
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        g_m = np.zeros((count, count))
        for t in range(length - 1):
            pair = alpha[:, t, :, None] * move * (beta[:, t + 1] * e[:, t + 1])[:, None, :]
            g_m -= (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        miss = -post
        np.put_along_axis(miss, gold[:, :, None], np.take_along_axis(miss, gold[:, :, None], 2) + 1, 2)
        by_word = np.stack([np.bincount(word.ravel(), miss[:, :, y].ravel(), minlength=len(starts)) for y in range(count)], axis=1)
        g_w = np.stack([np.bincount(slot, by_word[of, y], minlength=SLOTS) for y in range(count)], axis=1) / rows - 1e-4 * weights
        g_s = float((by_word * lex_of).sum()) / rows / length
        np.add.at(g_m, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1.0)
        g_m /= rows
        g_f = miss[:, 0].mean(axis=0)
        for i, g in enumerate((g_w, g_s, g_m, g_f)):
            seen[i] = seen[i] + g * g
        weights += rate * g_w / np.sqrt(seen[0])
        scale += 0.1 * rate * g_s / np.sqrt(seen[1])
        moves += rate * g_m / np.sqrt(seen[2])
        first += rate * g_f / np.sqrt(seen[3])
    return Model(langs, weights.astype(np.float32), lex, float(scale), moves, first)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows (doc_id, text, lang) without null texts or languages."""
    rows = labelled.filter("text is not null and lang is not null")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    lex = lexicon(rows.select(raw().alias("body"), "lang"), langs) if langs else np.zeros((SLOTS, 0), np.float32)
    rank = F.row_number().over(W.Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # `sample` ids for each language
    chosen = rows.select("doc_id", "lang").withColumn("rank", rank).filter(F.col("rank") <= sample).select("doc_id", F.col("lang").alias("of"))
    picked = rows.join(F.broadcast(chosen), "doc_id").filter(F.col("lang") == F.col("of")).select(F.substring("text", 1, SAMPLE_CHARS).cast("binary"), "lang").collect()
    return fit([(bytes(t), x) for t, x in picked], langs, lex)


def labelled(docs: DataFrame, model: Model) -> DataFrame:
    """(text, row, lang_pred, score) for every row of `docs`: `und` and 0.0 for a null text, one without letters, or where
    nothing was learned. Only the text is read; `row` holds all other columns unchanged, whatever their names
    (`common.unpacked`)."""
    docs = packed(docs, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: SLOTS rows for each language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in portions(batches, "text", 1 << 23):
            scores, sizes = [], []
            for small in portions([b], "text", 1 << 20):
                data, at = flat(small.column("text"))
                data = lowered(data)
                starts, ends, w_at = letter_runs(data, at)
                scores.append(emissions(model, data, starts, ends))
                sizes.append(np.diff(w_at))
            n = np.concatenate(sizes)
            known = b.column("__letters").to_numpy(zero_copy_only=False).astype(bool) & (n > 0) & (len(model.langs) > 0)
            at = np.concatenate([[0], np.cumsum(n)])
            total = marginals(model, np.concatenate(scores), at)[0] if model.langs else np.zeros((len(n), 1))
            best = total.argmax(axis=1)
            share = np.where(known, total[np.arange(len(n)), best] / np.maximum(n, 1), 0.0)
            pred = [model.langs[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), known.tolist(), strict=True)]
            columns = {name: b.column(name) for name in b.schema.names if name != "__letters"}
            yield pa.RecordBatch.from_pydict(columns | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(np.clip(share, 0.0, 1.0))})

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.withColumn("__letters", letters).mapInArrow(work, schema)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of `docs`. Repeated rows give equal results."""
    return labelled(docs.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score")


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))
