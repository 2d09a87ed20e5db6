"""Stateful streams that give what their batch twin gives: rows of a key are held until the watermark has passed them, then
taken in time order. A row older than the watermark when it comes is handed out as `late`, never dropped. State ends by
itself: timers take the rows, and a key that nothing waits for and whose memory has run out is cleared.

The state of a key is what arrived within the watermark's delay and one remembered row; keys share states in BUCKETS. Needs RocksDB as state store (`run_now` with
`state=True` sees to it)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: keys are dealt into this many buckets, whose state is read and written at once: a call for each key and batch would take most of the time
BUCKETS = 1024


class InOrder(StatefulProcessor):
    """`take` gets the times of a key (microseconds, ascending, each once it can no more be preceded) and what is remembered, and
    gives output rows and what is remembered next; `gone` says when that memory ends and what comes out then."""

    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "held binary")
        self.due = handle.getValueState("due", "ms long")

    def load(self) -> dict:
        """key: (waiting times, memory) of the bucket."""
        return pickle.loads(self.state.get()[0]) if self.state.exists() else {}

    def save(self, held: dict) -> None:
        if held:
            self.state.update((pickle.dumps(held, protocol=pickle.HIGHEST_PROTOCOL),))
        else:
            self.state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held, first = self.load(), None
        for r in rows:
            late = r["t"].to_numpy() < passed
            if late.any():
                yield self.table([(k, *self.late(int(t))) for k, t in zip(r["key"][late].tolist(), r["t"][late].tolist(), strict=True)])
            code, names = pd.factorize(r["key"][~late])
            t, order = r["t"].to_numpy()[~late], np.argsort(code, kind="stable")
            ends = np.cumsum(np.bincount(code, minlength=len(names)))[:-1]
            for name, new in zip(names.tolist(), np.split(t[order], ends), strict=True) if len(t) else ():
                waiting, memory = held.get(name, (None, None))
                held[name] = (new if waiting is None else np.concatenate([waiting, new]), memory)
            if len(t):
                first = int(t.min()) if first is None else min(first, int(t.min()))
        if first is not None:
            self.save(held)
            self.wake(first)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        kept, rows, wakes = {}, [], []
        for name, (waiting, memory) in self.load().items():
            t = np.sort(waiting)
            ready, rest = t[t < passed], t[t >= passed]
            out, memory = self.take(ready, memory) if len(ready) else ([], memory)
            # with rows still to come from `rest`, memory ends when they are taken
            if memory is not None:
                ends, last = self.gone(memory)
                if ends < passed and not (len(rest) and rest[0] <= ends):
                    out, memory = out + last, None
            rows += [(name, *x) for x in out]
            if len(rest) or memory is not None:
                kept[name] = (rest, memory)
                wakes.append(int(rest[0]) if len(rest) else self.gone(memory)[0])
        self.save(kept)
        if wakes:
            self.wake(min(wakes))
        if rows:
            yield self.table(rows)

    def wake(self, t: int) -> None:
        """A timer for when the watermark has passed `t`; the earliest one asked for is kept."""
        ms = t // 1000 + 1
        held = self.due.get()[0] if self.due.exists() else None
        if held is None or ms < held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def table(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", *self.columns])

    def close(self) -> None:
        pass

    def late(self, t: int) -> tuple:
        raise NotImplementedError

    def take(self, times: np.ndarray, memory: tuple | None) -> tuple[list[tuple], tuple]:
        raise NotImplementedError

    def gone(self, memory: tuple) -> tuple[int, list[tuple]]:
        raise NotImplementedError


class Remember(InOrder):
    """A time is `taken` when none was taken in the `ttl` microseconds before it."""

    columns = ["t", "kind"]

    def __init__(self, ttl: int):
        self.ttl = ttl

    def late(self, t: int) -> tuple:
        return t, "late"

    def take(self, times: np.ndarray, memory: tuple | None) -> tuple[list[tuple], tuple]:
        out, last = [], memory[0] if memory else None
        i = 0 if last is None else int(np.searchsorted(times, last + self.ttl, side="right"))
        while i < len(times):  # once for each time taken
            last = int(times[i])
            out.append((last, "taken"))
            i = int(np.searchsorted(times, last + self.ttl, side="right"))
        return out, (last,)

    def gone(self, memory: tuple) -> tuple[int, list[tuple]]:
        return memory[0] + self.ttl, []


class Sessions(InOrder):
    """Runs of times less than `gap` microseconds apart; a run comes out when nothing can join it any more."""

    columns = ["start", "end", "residues", "kind"]

    def __init__(self, gap: int):
        self.gap = gap

    def late(self, t: int) -> tuple:
        return t, t + self.gap, 1, "late"

    def take(self, times: np.ndarray, memory: tuple | None) -> tuple[list[tuple], tuple]:
        new = np.flatnonzero(np.append(True, np.diff(times) >= self.gap))
        firsts, lasts = times[new].tolist(), times[np.append(new[1:], len(times)) - 1].tolist()
        sizes = np.diff(np.append(new, len(times))).tolist()
        out = []
        if memory is not None:
            first, last, n = memory
            if firsts[0] - last < self.gap:
                firsts[0], sizes[0] = first, sizes[0] + n
            else:
                out.append((first, last + self.gap, n, "run"))
        out += [(f, e + self.gap, n, "run") for f, e, n in zip(firsts[:-1], lasts[:-1], sizes[:-1], strict=True)]
        return out, (firsts[-1], lasts[-1], sizes[-1])

    def gone(self, memory: tuple) -> tuple[int, list[tuple]]:
        first, last, n = memory
        return last + self.gap, [(first, last + self.gap, n, "run")]


def _held(stream: DataFrame, key: str, time: str, delay: str) -> GroupedData:
    # without the column that the watermark is on, late rows reach the processor, which hands them out
    d = stream.withWatermark(time, delay).select(F.col(key).alias("key"), F.unix_micros(F.col(time)).alias("t")).filter("key is not null and t is not null")
    return d.select(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket"), "key", "t").groupBy("bucket")


def _schema(stream: DataFrame, key: str, *longs: str) -> StructType:
    return StructType([StructField("key", stream.schema[key].dataType), *[StructField(c, LongType()) for c in longs], StructField("kind", StringType())])


def remembered(stream: DataFrame, key: str, time: str, ttl_seconds: float, delay: str) -> DataFrame:
    """(key, t, kind): `taken` for the times at which a key is not remembered, as none was taken within `ttl_seconds` before;
    `late` for rows that came after the watermark (`delay` behind the newest). Over all rows that are not late the taken ones are
    those of one pass in time order, however the rows were spread over batches."""
    return _held(stream, key, time, delay).transformWithStateInPandas(Remember(round(ttl_seconds * 1e6)), _schema(stream, key, "t"), "append", "EventTime")


def content_once(stream: DataFrame, content: list[str], time: str, ttl_seconds: float, delay: str) -> DataFrame:
    """(hash, t, kind): `taken` the first time a content is seen, and again when it was not taken for `ttl_seconds`; `late` as in
    `remembered`. Nulls in a content are told from empty texts."""
    part = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in content]
    return remembered(stream.withColumn("hash", F.sha2(F.concat_ws("|", *part), 256)), "hash", time, ttl_seconds, delay).withColumnRenamed("key", "hash")


def sessions(stream: DataFrame, key: str, time: str, gap_seconds: float, delay: str) -> DataFrame:
    """(key, start, end, residues, kind): a `run` for each stretch of rows less than `gap_seconds` apart, once, when the watermark has passed
    its end (the last row plus the gap); `late` rows one by one."""
    return _held(stream, key, time, delay).transformWithStateInPandas(Sessions(round(gap_seconds * 1e6)), _schema(stream, key, "start", "end", "residues"), "append", "EventTime")
