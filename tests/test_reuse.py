"""Reuse within a time to live: composed chunk maps against a plain walk."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.operators import sessions

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def walk(rows, ttl):
    """{key: [calls, hits, saved]}; rows: (key, ms, id, mtime, tokens)."""
    out = {}
    ticks = {}
    for key, ms, number, mtime, tokens in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        ticks.setdefault((key, ms), []).append((mtime or 0, tokens))
    entry = {}
    for (key, ms), calls in ticks.items():
        total = out.setdefault(key, [0, 0, 0])
        newest = max(m for m, _ in calls)
        tick, mtime = entry.get(key, (None, None))
        missed = tick is None or ms > tick + ttl or newest > mtime
        if missed:
            entry[key] = (ms, newest)
        total[0] += len(calls)
        total[1] += len(calls) - missed
        total[2] += sum(t for _, t in calls) - (calls[0][1] if missed else 0)
    return {k: tuple(v) for k, v in out.items()}


def spark_rows(spark, rows, ttl):
    calls = spark.createDataFrame(
        [(k, T0 + timedelta(milliseconds=ms), i, m, t) for k, ms, i, m, t in rows], "key string, ts timestamp, id bigint, mtime_ms bigint, tokens bigint")
    return {r.key: (r.calls, r.hits, r.tokens_saved) for r in sessions.reuse(calls, ttl).collect()}


@pytest.mark.parametrize("chunk", [1, 2, 16])
def test_maps_equal_the_walk(spark, monkeypatch, chunk):
    monkeypatch.setattr(sessions, "CHUNK_BLOCKS", chunk)
    rng = random.Random(chunk)
    rows, number = [], 0
    for key, steps, changes in (("dense", (1, 9), 0.0), ("newer", (1, 30), 0.2), ("sparse", (1, 400), 0.1), ("back", (0, 12), 0.3), ("regular", (10, 10), 0.0)):
        ms, mtime = rng.randint(0, 50), 0
        for _ in range(700):
            ms += rng.randint(*steps)
            if rng.random() < changes:
                mtime += rng.randint(1, 5) if key != "back" else rng.randint(-5, 5)
            number += 1
            rows.append((key, ms, number, None if rng.random() < 0.05 else mtime, rng.randint(0, 9)))
    rng.shuffle(rows)
    assert spark_rows(spark, rows, 100) == walk(rows, 100)


def test_one_key_without_gaps_runs_in_many_chunks(spark):
    rows = [("hot", ms, ms, ms // 5000, 1) for ms in range(0, 40_000, 3)]
    assert spark_rows(spark, rows, 50) == walk(rows, 50)
    calls = spark.createDataFrame([(r[1],) for r in rows], "tick bigint")
    assert calls.select(F.floor(F.col("tick") / (50 * sessions.CHUNK_BLOCKS))).distinct().count() == 50


def test_next_stores_equal_a_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(50):
        ticks = np.unique(rng.integers(0, 300, 60))
        mtimes = rng.integers(0, 6, len(ticks))
        want = [next((j for j in range(i + 1, len(ticks)) if ticks[j] > ticks[i] + 40 or mtimes[j] > mtimes[i]), len(ticks)) for i in range(len(ticks))]
        assert sessions.next_stores(ticks, mtimes, 40).tolist() == want
    assert len(sessions.next_stores(np.zeros(0, np.int64), np.zeros(0, np.int64), 5)) == 0


def test_no_calls(spark):
    assert spark_rows(spark, [], 100) == {}
