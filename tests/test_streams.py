"""Streams over several files, with rows out of order, late ones, and memory that runs out."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest

from molframe.streaming import in_order as O
from molframe.streaming import stream as S

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
MINUTE = 60_000_000


def files(spark, tmp_path, parts):
    """One file after the other: (key, minute) rows."""
    for i, rows in enumerate(parts):
        d = spark.createDataFrame([(k, T0 + timedelta(minutes=m)) for k, m in rows], "key long, ts timestamp")
        d.coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
        time.sleep(0.02)
    return spark.readStream.schema("key long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def judged(parts, delay):
    """Which rows come after the watermark, file by file."""
    on, late, top = [], [], None
    for rows in parts:
        for k, m in rows:
            (late if top is not None and m < top - delay else on).append((k, m))
        top = max([m for _, m in rows] + ([top] if top is not None else []))
    return on, late


def shuffled(seed, n=400, files_=6, span=3000, keys=5):
    rng = random.Random(seed)
    parts = [[] for _ in range(files_)]
    for _ in range(n):
        m = rng.randrange(span)
        p = min(files_ - 1, m * files_ // span + rng.choice([0, 0, 0, 1, 3]))
        parts[p].append((rng.randrange(keys), m))
    return parts + [[(99, span + 100_000)]]  # the last one moves the watermark past all


def minute(t):
    return round((t - T0.timestamp() * 1e6) / MINUTE)


@pytest.mark.parametrize("seed", [1, 2])
def test_remembered_equals_one_pass_in_time_order(spark, tmp_path, seed):
    parts = shuffled(seed)
    on, late = judged(parts, 700)
    assert late
    want = []
    for key in range(5):
        last = None
        for m in sorted(m for k, m in on if k == key):
            if last is None or m - last > 90:
                want.append((key, m))
                last = m
    seen = []
    out = S.run_now(O.remembered(files(spark, tmp_path, parts), "key", "ts", 90 * 60, "700 minutes"), state=True, progress=seen)
    rows = [(r.key, minute(r.t), r.kind) for r in out.collect() if r.key != 99]
    assert sorted((k, m) for k, m, kind in rows if kind == "taken") == sorted(want)
    assert sorted((k, m) for k, m, kind in rows if kind == "late") == sorted(late)
    # what was held is gone at the end but for the key of the last file
    held = [p["stateOperators"][0]["customMetrics"].get("rocksdbNumInternalColFamiliesKeys", 0) + p["stateOperators"][0]["numRowsTotal"] for p in seen if p["stateOperators"]]
    assert held[-1] < max(held) / 3


def test_sessions_come_once_and_late_rows_beside_them(spark, tmp_path):
    parts = shuffled(5)
    on, late = judged(parts, 700)
    want = []
    for key in range(5):
        run = []
        for m in sorted(m for k, m in on if k == key):
            if run and m - run[-1] >= 40:
                want.append((key, run[0], run[-1] + 40, len(run)))
                run = []
            run.append(m)
        if run:
            want.append((key, run[0], run[-1] + 40, len(run)))
    out = S.run_now(O.sessions(files(spark, tmp_path, parts), "key", "ts", 40 * 60, "700 minutes"), state=True).collect()
    got = [(r.key, minute(r.start), minute(r.end), r.residues) for r in out if r.kind == "run" and r.key != 99]
    assert sorted(got) == sorted(want)
    assert sorted((r.key, minute(r.start)) for r in out if r.kind == "late") == sorted(late)
    assert len({r.batch for r in out if r.kind == "run"}) > 2


def test_take_and_gone_without_spark():
    import numpy as np

    r = O.Remember(10)
    assert r.take(np.array([1, 5, 11, 12, 22, 40]), None) == ([(1, "taken"), (12, "taken"), (40, "taken")], (40,))
    assert r.take(np.array([41, 50]), (40,)) == ([], (40,)) and r.gone((40,)) == (50, [])
    s = O.Sessions(10)
    assert s.take(np.array([5, 9, 30]), None) == ([(5, 19, 2, "run")], (30, 30, 1))
    assert s.take(np.array([39, 60]), (30, 30, 1)) == ([(30, 49, 2, "run")], (60, 60, 1))
    assert s.take(np.array([40]), (30, 30, 1)) == ([(30, 40, 1, "run")], (40, 40, 1))


def test_keys_of_a_bucket_share_one_state():
    import numpy as np
    import pandas as pd

    calls = []

    class Value:
        v = None

        def exists(self):
            return self.v is not None

        def get(self):
            calls.append("get")
            return self.v

        def update(self, v):
            calls.append("update")
            self.v = v

        def clear(self):
            self.v = None

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return Value()

        def registerTimer(self, ms):  # noqa: N802
            self.timer = ms

        def deleteTimer(self, ms):  # noqa: N802
            pass

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    p, h = O.Remember(10_000), Handle()
    p.init(h)
    rows = pd.DataFrame({"key": np.repeat([f"k{i}" for i in range(500)], 3), "t": np.tile([5_000, 1_000, 30_000], 500)})
    assert list(p.handleInputRows((0,), iter([rows]), At(0))) == []
    out = pd.concat(p.handleExpiredTimer((0,), At(20), None))
    assert len(out) == 500 and set(out["t"]) == {1_000}
    out = pd.concat(p.handleExpiredTimer((0,), At(100), None))
    assert len(out) == 500 and set(out["t"]) == {30_000} and set(out["key"]) == set(rows["key"])
    assert not p.state.exists() and not p.due.exists() and len(calls) < 12
