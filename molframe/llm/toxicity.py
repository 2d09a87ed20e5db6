"""Toxic spans and document scores by a linear-chain conditional random field.

The words of a sentence are labelled as toxic or not. A word's score sums learned weights of itself, its beginnings of three to
eight bytes and its last three to five; transitions between neighbouring words are learned too. Forward-backward gives each
word's marginal. A document's score is a logistic function of the expected number of toxic words and its length;
neighbouring words with a marginal of half or more are the offending spans.

Labels are known for documents only, so words of toxic documents are labelled from them: first those with a feature that
occurs in far more of the toxic documents than of the others, then, after each fit, those that the fitted model marks.
Words of other documents are not toxic. All is fitted on a bounded sample: SAMPLE documents of either label, each of at most
SAMPLE_CHARS characters, copies counting once; prediction reads whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import flat, portions
from .langid import letter_runs, lowered
from .repeats import word_hashes

SAMPLE, SAMPLE_CHARS = 1000, 16_000
BITS = 18
SLOTS = 1 << BITS
HEADS, TAILS = range(3, 9), range(3, 6)
#: words of a sequence when fitting
LENGTH = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())]))


class Model(NamedTuple):
    weights: np.ndarray  # one for each slot, and a last 0 for features that a word lacks
    bias: float
    moves: np.ndarray  # 2 x 2, from (not toxic, toxic) to the same
    document: np.ndarray  # constant, log of expected toxic words, log of words


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The slot of each feature of each word; SLOTS where the word is too short for it."""
    room = max(HEADS)
    pad = np.concatenate([np.zeros(room, np.uint64), data.astype(np.uint64), np.zeros(room, np.uint64)])
    n = ends - starts
    slot = lambda value, kind: ((value ^ np.uint64(kind)) * _ODD * _ODD >> np.uint64(64 - BITS)).astype(np.int32)
    mixed = lambda value, kind: slot((value ^ value >> np.uint64(29)) * _ODD, kind)
    out = [mixed(word_hashes(data, starts, ends), 1)]
    value = np.zeros(len(starts), np.uint64)
    for i in range(max(HEADS)):
        value = value << np.uint64(8) | pad[starts + room + i]
        if i + 1 in HEADS:
            out.append(np.where(n > i, mixed(value, 2 + i), SLOTS).astype(np.int32))
    value = np.zeros(len(starts), np.uint64)
    for i in range(max(TAILS)):
        value = value | pad[ends + room - 1 - i] << np.uint64(8 * i)
        if i + 1 in TAILS:
            out.append(np.where(n > i, mixed(value, 32 + i), SLOTS).astype(np.int32))
    return out


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased texts, where each text's words begin, and where each sentence's do. A
    sentence ends at `.`, `!`, `?`, a line end or the text's end."""
    starts, ends, w_at = letter_runs(data, at)
    stop = np.concatenate([[0], np.cumsum((data == 46) | (data == 33) | (data == 63) | (data == 10))])
    mark = stop[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = mark[1:] != mark[:-1]
    new[w_at[:-1][np.diff(w_at) > 0]] = True
    return starts, ends, w_at, np.append(np.flatnonzero(new), len(starts))


def chain(scores: np.ndarray, moves: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chance that each word is toxic, by forward-backward, all sequences step by step together; and the expected number of
    each of the four moves. `scores` are those of the toxic label; that of the other is 0."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    pairs = np.zeros((2, 2))
    if not len(order):
        return np.zeros(0), pairs
    begin, size = at[:-1][order], size[order]
    top = np.clip(scores, -30.0, 30.0)
    e = np.stack([1.0 / (1.0 + np.exp(top)), 1.0 / (1.0 + np.exp(-top))], axis=1)
    move = np.exp(moves)
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")
    alpha = np.empty_like(e)
    a = e[begin]
    a = a / a.sum(axis=1, keepdims=True)
    alpha[begin] = a
    for t in range(1, int(size[0])):
        i = begin[: active[t]] + t
        a = (a[: active[t]] @ move) * e[i]
        a /= a.sum(axis=1, keepdims=True)
        alpha[i] = a
    toxic = np.empty(len(e))
    b = np.ones((0, 2))
    for t in range(int(size[0]) - 1, -1, -1):
        m = active[t]
        i = begin[:m] + t
        if len(b):
            ahead = b * e[begin[: len(b)] + t + 1]
            both = alpha[i[: len(b)], :, None] * move * ahead[:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = ahead @ move.T
            b /= b.sum(axis=1, keepdims=True)
        if m > len(b):
            b = np.concatenate([b, np.full((m - len(b), 2), 0.5)])
        p = alpha[i] * b
        toxic[i] = p[:, 1] / p.sum(axis=1)
    return toxic, pairs


def emission(weights: np.ndarray, bias: float, slots: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(slots[0]), bias, dtype=np.float64)
    for s in slots:
        out += weights[s]
    return out


def telling(slots: list[np.ndarray], which: np.ndarray, doc: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The slots that occur in far more of the toxic documents than of the others, as a mark for each slot."""
    docs = len(label)
    pair = np.unique(which.astype(np.int64) * docs + doc)
    which, doc = pair // docs, pair % docs
    seen = np.zeros((2, SLOTS + 1))
    for s in slots:
        both = np.unique(s[which].astype(np.int64) * docs + doc)
        for y in (0, 1):
            seen[y] += np.bincount((both // docs)[label[both % docs] == y], minlength=SLOTS + 1)
    n = np.maximum(np.bincount(label, minlength=2), 1)
    rate = (seen[0] + 1.0) / n[0]
    usual = rate * n[1]
    out = (seen[1] >= 4) & (seen[1] - usual > 8.0 * np.sqrt(usual)) & (rate < 0.3 * seen[1] / n[1])
    out[SLOTS] = False
    return out


def distinct(texts: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """Texts without near copies: of those with the same least hash of five words, and the same label, one stays."""
    held: dict[tuple, tuple[bytes, int]] = {}
    for t, y in sorted(texts):
        data = lowered(np.frombuffer(t, dtype=np.uint8))
        starts, ends, _ = letter_runs(data, np.array([0, len(data)]))
        h = word_hashes(data, starts, ends)
        key = 0
        if len(h):
            five = np.zeros(max(1, len(h) - 4), np.uint64)
            for i in range(min(5, len(h))):
                five = five * _ODD + h[i : i + len(five)]
            key = int((five ^ five >> np.uint64(31)).min())
        held.setdefault((key, y), (t, y))
    return list(held.values())


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Coefficients by Newton steps, lightly shrunk."""
    c = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        c += np.clip(np.linalg.solve(h, x.T @ (y - p) - 1e-3 * c), -3.0, 3.0)
    return c


def summed(toxic: np.ndarray, w_at: np.ndarray) -> np.ndarray:
    """What a document is judged by: a constant, the log of its expected toxic words, and the log of its words."""
    total = np.concatenate([[0.0], np.cumsum(toxic)])
    expected = np.maximum(total[w_at[1:]] - total[w_at[:-1]], 0.0)
    return np.stack([np.ones(len(expected)), np.log(expected + 0.02), np.log(np.diff(w_at) + 10.0)], axis=1)


def fit(texts: list[tuple[bytes, int]], share: float | None = None, stages: int = 2, rounds: int = 30, rate: float = 0.5) -> Model:
    """A model fitted to (text, 0 or 1). `share` is that of toxic documents where the model is to be used, if it is not that of
    the texts. With one label or none given, every document scores that label (0 if none)."""
    weights, moves = np.zeros(SLOTS + 1), np.array([[0.0, -1.0], [0.0, 0.0]])
    texts = distinct(texts)
    label = np.array([y for _, y in texts], dtype=np.int64)
    if len(np.unique(label)) < 2:
        return Model(weights.astype(np.float32), -30.0, moves, np.array([20.0 if label.any() else -20.0, 0.0, 0.0]))
    data = lowered(np.frombuffer(b"".join(t for t, _ in texts), dtype=np.uint8))
    at = np.concatenate([[0], np.cumsum([len(t) for t, _ in texts])]).astype(np.int64)
    starts, ends, w_at, s_at = words(data, at)
    # long sentences are fitted in pieces
    s_at = np.unique(np.concatenate([s_at, *[np.arange(a, b, LENGTH) for a, b in zip(s_at[:-1], s_at[1:], strict=True) if b - a > LENGTH]]))
    doc = np.repeat(np.arange(len(texts)), np.diff(w_at))
    # words are looked at once each
    _, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    order = np.argsort(first)
    first, which = first[order], np.argsort(order)[which]
    slots = features(data, starts[first], ends[first])
    may = label[doc] == 1
    mark = telling(slots, which, doc, label)
    gold = may & np.any([mark[s] for s in slots], axis=0)[which]
    toxic = np.zeros(len(starts))
    bias = -3.0
    inner = np.ones(len(starts), dtype=bool)
    inner[s_at[:-1]] = False
    for _ in range(stages):
        weights, bias, seen = np.zeros(SLOTS + 1), -3.0, [np.full(SLOTS + 1, 1e-6), 1e-6, np.full((2, 2), 1e-6)]
        was, now = gold[:-1][inner[1:]].astype(int), gold[1:][inner[1:]].astype(int)
        found = np.bincount(was * 2 + now, minlength=4).reshape(2, 2)
        for _ in range(rounds):
            toxic, pairs = chain(emission(weights, bias, slots)[which], moves, s_at)
            miss = gold - toxic
            by_word = np.bincount(which, miss, minlength=len(first))
            g_w = sum(np.bincount(s, by_word, minlength=SLOTS + 1) for s in slots) - 0.2 * weights
            g_w[SLOTS] = 0.0
            g = (g_w, miss.sum(), found - pairs - 0.1 * moves)
            seen = [a + b * b for a, b in zip(seen, g, strict=True)]
            weights += rate * g[0] / np.sqrt(seen[0])
            bias += rate * g[1] / np.sqrt(seen[1])
            moves = moves + 0.3 * rate * g[2] / np.sqrt(seen[2])
        toxic, _ = chain(emission(weights, bias, slots)[which], moves, s_at)
        gold = may & (toxic >= 0.5)
    document = logistic(summed(toxic, w_at), label)
    if share is not None:
        odds = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / np.clip(1 - p, 1e-6, 1 - 1e-6))
        document[0] += odds(share) - odds(label.mean())
    return Model(weights.astype(np.float32), float(bias), moves, document)


def judge(model: Model, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Scores of texts (UTF-8, one after the other), and their spans in code points."""
    low = lowered(data)
    starts, ends, w_at, s_at = words(low, at)
    toxic, _ = chain(emission(model.weights, model.bias, features(low, starts, ends)), model.moves, s_at)
    score = 1.0 / (1.0 + np.exp(-np.clip(summed(toxic, w_at) @ model.document, -30, 30)))
    spans: list[list[tuple[int, int, float]]] = [[] for _ in range(len(at) - 1)]
    hit = np.flatnonzero(toxic >= 0.5)
    if len(hit):
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        owner = np.searchsorted(w_at, hit, side="right") - 1
        sentence = np.searchsorted(s_at, hit, side="right")
        joined = np.append(False, (np.diff(hit) == 1) & (np.diff(sentence) == 0))
        first = np.flatnonzero(~joined)
        last = np.append(first[1:], len(hit)) - 1
        best = np.maximum.reduceat(toxic[hit], first)
        for f, l, p in zip(first.tolist(), last.tolist(), best.tolist(), strict=True):
            o = owner[f]
            zero = points[at[o]]
            spans[o].append((int(points[starts[hit[f]]] - zero), int(points[ends[hit[l]]] - zero), p))
    return score, spans


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[bytes, int]]:
    """At most `sample` texts of either label, of at most SAMPLE_CHARS characters, spread by a hash of the id. Rows with a null id, text
    or label are left out; a text with several labels comes once with each."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic").distinct()
    short = docs.filter(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text")
    picked: list[tuple[bytes, int]] = []
    for y in (0, 1):
        ids = known.filter(F.col("toxic") == y).join(short.select("doc_id").distinct(), "doc_id", "left_semi")
        ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id")
        # `sample` ids at most; of rows that share an id one text is taken
        rows = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        picked += [(bytes(t), y) for (t,) in rows.select(F.col("text").cast("binary")).collect()]
    return picked


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the rows of `docs` (doc_id, text) that `labels` (doc_id, toxic) marks with 0 or 1. Empty tables give a model
    that scores nothing as toxic."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic").distinct()
    share = docs.filter("text is not null").select("doc_id").join(known, "doc_id").agg(F.avg("toxic")).first()[0]
    return fit(labelled(docs, labels), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, spans) for every row of `docs`: the chance that it is toxic, 1 if that is 0.5 or more, and
    its toxic spans (start, end in code points, largest marginal of the words). Only the text is judged; a null text counts as empty,
    and an empty one gets the score of a text without words. Equal texts score alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: SLOTS weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            value, spans = judge(shared.value, *flat(b.column("body")))
            rows = [[{"start": s, "end": e, "score": p} for s, e, p in x] for x in spans]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(rows, kind)], names=["doc_id", "score", "predicted", "spans"])

    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType if "doc_id" in docs.columns else LongType()), StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("spans", SPANS)])
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", body.alias("body")).mapInArrow(work, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
