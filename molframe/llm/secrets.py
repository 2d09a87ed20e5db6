"""Secret scans: fixed patterns, and strings that dictionary-primed zstandard finds new in a sensitive place.

A compressor is primed with the most frequent identifiers of all distinct texts that hold a sensitive word, candidates left out. A candidate is a
string of at least NOVEL_CHARS characters with letters or digits, not part of a pattern's match, within REACH characters
after a sensitive word. Its cost is what it adds to the compressed size of the text around it: names made of known parts
cost few bytes, keys cost as much as random strings of their length and alphabet do in the same place. Such twins are
compressed beside each candidate; candidates above a share of the cheapest twin are reported as `novel`."""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of hex digits is one match
KINDS = ("assign", "access", "hex", "novel")
#: what the assign pattern's words have in common, lower-cased
ASSIGN_HINTS = ("passw", "secret", "token", "api")
SENSITIVE = re.compile(r"(?ai:passw(?:or)?d|passphrase|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|authorization|bearer)")
HINTS = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "authorization", "bearer")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,}")
NOVEL_CHARS, REACH, AROUND = 12, 80, 200
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{NOVEL_CHARS},}}")
IDENTIFIERS = 4000
TWINS = 8
CLASSES = (string.digits, string.ascii_lowercase, string.ascii_uppercase)
HEX_DIGITS = (frozenset("0123456789abcdef"), frozenset("0123456789ABCDEF"))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order."""
    out = []
    lower = text.lower()
    if any(h in lower for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def placed(text: str) -> Iterator[re.Match[str]]:
    """Strings of a candidate's characters and length within REACH after a sensitive word, in order, each once."""
    done = 0
    for word in SENSITIVE.finditer(text):
        # only the first NOVEL_CHARS of a candidate have to lie before `last`; the match itself runs on
        last = word.end() + REACH + NOVEL_CHARS
        while near := CANDIDATE.search(text, max(word.end(), done), last):
            m = CANDIDATE.match(text, near.start())
            done = m.end()
            yield m


def mixed(found: str) -> bool:
    return any(c.isdigit() for c in found) and any(c.isalpha() for c in found)


def twins(found: str) -> Iterator[str]:
    """Random strings of the same length over the classes of characters that `found` has, the same on every run."""
    own = {c for c in found if c.isalnum()}
    hexed = [h for h in HEX_DIGITS if own <= h] if mixed(found) else []
    letters = sorted(hexed[0]) if hexed else "".join(c for c in CLASSES if own & set(c))
    for i in range(TWINS):
        rng = random.Random(f"{i} {found}")
        yield "".join(rng.choice(letters) if c.isalnum() else c for c in found)


def is_novel(text: str, m: re.Match[str], squeeze: zstandard.ZstdCompressor, limit: float) -> bool:
    """Whether the match adds at least `limit` bytes for each character, or as much of what the cheapest twin adds."""
    found = m.group()
    if not any(c.isalnum() for c in found):
        return False
    about = text[max(0, m.start() - AROUND) : m.start()] + text[m.end() : m.end() + AROUND]
    size = lambda more: len(squeeze.compress((about + more).encode("utf-8", "replace")))
    around = size("")
    cost = size(found) - around
    # words have no digits to tell them from a key, so a byte a character is not enough for them
    if mixed(found) and cost >= limit * len(found):
        return True
    return cost > 0 and cost >= limit * min(size(t) - around for t in twins(found))


def novel_spans(text: str, taken: list[tuple[int, int, int]], squeeze: zstandard.ZstdCompressor, limit: float) -> list[tuple[int, int, int]]:
    """Candidates that cost about what random strings of their length and alphabet cost in their place."""
    lower = text.lower()
    if not any(h in lower for h in HINTS):
        return []
    starts = [s for s, _, _ in taken]
    reach = list(accumulate((e for _, _, e in taken), max))

    def is_free(m: re.Match[str]) -> bool:
        before = bisect_left(starts, m.end())
        return not before or reach[before - 1] <= m.start()

    free = (m for m in placed(text) if is_free(m))
    return [(m.start(), 3, m.end()) for m in free if is_novel(text, m, squeeze, limit)]


def names_of(text: str, squeeze: zstandard.ZstdCompressor, limit: float) -> dict[str, bool]:
    """The text's identifiers; true are those that touch a string in a sensitive place which has letters and digits, or is
    novel to a compressor that knows the text around it alone, whether or not a pattern also matches it."""
    spans = [m.span() for m in placed(text) if mixed(m.group()) or is_novel(text, m, squeeze, limit)]
    out: dict[str, bool] = {}
    i = 0
    for m in IDENTIFIER.finditer(text):
        while i < len(spans) and spans[i][1] <= m.start():
            i += 1
        out[m.group()] = out.get(m.group(), False) or (i < len(spans) and spans[i][0] < m.end())
    return out


def identifiers(docs: DataFrame, most: int = IDENTIFIERS, limit: float = 0.9) -> bytes:
    """The dictionary: the `most` identifiers found in most distinct texts with a sensitive word, the most frequent last.

    Copies of a text count once, and a name counts once in a text. Names that may be a secret anywhere, or part of one, are
    left out, so that a secret in many places doesn't make itself known."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3, write_content_size=False)
        for b in portions(batches, "text"):
            held: dict[tuple[bytes, str], bool] = {}
            for text in b.column("text").to_pylist():
                lower = text.lower()
                if any(h in lower for h in HINTS) and SENSITIVE.search(text):
                    digest = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()
                    held.update({(digest, name): out for name, out in names_of(text, squeeze, limit).items()})
            if held:
                digests, names = zip(*held)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(names, pa.string()), pa.array(held.values(), pa.bool_())], names=["text", "name", "out"])

    counted = docs.filter("text is not null").select("text").mapInArrow(count, "text binary, name string, out boolean").filter(F.length("name") <= 64)
    # copies meet before the shuffle and again by (text, name), never all in one task
    once = counted.groupBy("text", "name").agg(F.max("out").alias("out"))
    top = once.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("out").alias("out")).filter("n > 1 and not out").orderBy(F.desc("n"), "name").limit(most).collect()
    return " ".join(r[0] for r in reversed(top)).encode()


def scan(docs: DataFrame, limit: float = 0.9, dictionary: bytes | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, found) for every row of `docs`; `found` lists (kind, start, end) by
    start, then kind, in characters, end exclusive.

    Pattern matches are leftmost and do not overlap others of their kind; matches that are too short are dropped. Null
    and empty texts hold nothing. `dictionary` primes the compressor; without it, it is counted over `docs`. Each row is
    judged by itself, so repeated rows agree. Other columns are not read."""
    words = identifiers(docs, limit=limit) if dictionary is None else dictionary

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prime = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(words) >= 8 else None
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=prime, write_content_size=False)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in portions(batches, "text"):
            found, counts = [], []
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                spans = sorted(base + novel_spans(text, base, squeeze, limit))
                by = Counter(k for _, k, _ in spans)
                counts.append([by[k] for k in range(4)])
                found.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns, pa.array(found, kind)], names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "found"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, found array<struct<kind:string,start:long,end:long>>"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, schema)
