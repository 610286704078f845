"""Stateful accounting against a plain replay of the log."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.streaming import stateful, windows

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def log(spark, seed, n=400, hot=0.6, step=9):
    """A log in which one key holds most events, with equal times among them."""
    rng, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += rng.choice([0, 1, 2, step, 60, rng.random() * 90]) if rng.random() < .9 else 200
        rows.append((1 if rng.random() < hot else rng.randint(2, 5), i, START + timedelta(seconds=round(t, 3)), rng.random() < .5))
    return rows, spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, failed boolean")


def replay_admit(rows, per_minute, per_day):
    state, out = {}, {}
    for key, event, ts, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        ok = []
        for width, limit in ((60, per_minute), (86400, per_day)):
            start, count = state.get((key, width), (None, 0))
            if start is None or (ts - start).total_seconds() > width:
                start, count = ts, 0
            state[key, width] = (start, count + 1)
            ok.append(count + 1 <= limit)
        out[event] = all(ok)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_admission(spark, seed):
    rows, df = log(spark, seed)
    got = {r["event_id"]: r["admitted"] for r in windows.admit_per_key(df, per_minute=3, per_day=60).collect()}
    assert got == replay_admit(rows, 3, 60)


def test_cache(spark):
    rows, df = log(spark, 5)
    stored, want = {}, {}
    for key, event, ts, failed in sorted(rows, key=lambda r: (r[2], r[1])):
        hit = key in stored and stored[key] < ts and (ts - stored[key]).total_seconds() < 120
        want[event] = "cache" if hit else "ai"
        if not hit and not failed and (key not in stored or (ts - stored[key]).total_seconds() >= 120):
            stored[key] = ts
    got = {r["event_id"]: r["source"] for r in windows.cache_attribution(df, "user_id", "ts", "failed", 120).collect()}
    assert got == want


def test_global_budget(spark):
    rows, df = log(spark, 6)
    logged, want = [], {}
    for _, event, ts, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        logged = [t for t in logged if (ts - t).total_seconds() < 60]
        want[event] = len(logged) < 4
        if want[event]:
            logged.append(ts)
    got = {r["event_id"]: r["admitted"] for r in stateful.admit_global(df, limit=4).collect()}
    assert got == want


def test_next_admitted_in_batches():
    """A saturated log: every pass sees only what the last one has admitted."""
    rng = np.random.default_rng(4)
    times = np.sort(rng.integers(0, 4000, 900))
    logged, want = [], []
    for i, t in enumerate(times.tolist()):
        if sum(t - x < 100 for x in logged[-5:]) < 5:
            logged.append(t)
            want.append(i)
    got, recent = [], []
    for at in range(0, 900, 64):
        places, recent = stateful.next_admitted(times[at:at + 64], recent, 5, 100)
        got += [at + p for p in places]
    assert got == want


def test_breaker_in_batches():
    rng = np.random.default_rng(6)
    for trial in range(300):
        n, need, pause = int(rng.integers(1, 60)), int(rng.integers(1, 4)), int(rng.integers(1, 30))
        times, failed = np.sort(rng.integers(0, 100, n)), rng.random(n) < 0.6
        count = until = 0
        want = []
        for now, bad in zip(times.tolist(), failed.tolist(), strict=True):
            made = now >= until
            want.append(made)
            if made:
                count = (0 if until and count >= need else count) + 1 if bad else 0
                until = now + pause if count >= need else until
        for size in (n, 1, 7):
            got, state = [], (0, 0)
            for at in range(0, n, size):
                made, *state = stateful.breaker_trips(times[at:at + size], failed[at:at + size], *state, need, pause)
                got += made.tolist()
            assert got == want, (trial, size)


def test_stream_in_several_batches_equals_batch(spark, tmp_path):
    rows, df = log(spark, 8)
    for i, part in enumerate([df.where("event_id < 150"), df.where("event_id between 150 and 299"), df.where("event_id > 299")]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(
        str(tmp_path / "in"))
    got = stateful.run_to_table(stateful.admit_per_key_stream(stream, 3, 60), "t")
    assert {r["event_id"]: r["admitted"] for r in got.collect()} == replay_admit(rows, 3, 60)


def test_rate_windows(spark):
    rows, df = log(spark, 9)
    got = windows.request_rate_windows(df).agg(F.sum("n")).first()[0]
    assert got == len(rows)
