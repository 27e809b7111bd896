"""Hard-negative mining against brute force; Strassen products against plain ones."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscope.llm import negatives


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(1, 90), st.integers(1, 90), st.integers(0, 9), st.sampled_from([3, 1 << 20, 1 << 28]))
def test_strassen_is_exact(m, k, n, seed, high):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-high, high, (m, k)), rng.integers(-high, high, (k, n))
    want = a.astype(object) @ b.astype(object)
    for leaf in (4, 32):
        before, negatives.LEAF = negatives.LEAF, leaf
        try:
            assert (negatives.strassen(a, b) == want).all()
        finally:
            negatives.LEAF = before


def test_products_beyond_long_are_held_to_its_range():
    a = np.array([[2**62, 2**62], [1, 0]], np.int64)
    assert negatives.scores_of(a, a).tolist() == [[2**63 - 1, 2**62], [2**62, 1]]


def brute(rows, is_anchor, positives=5, most=3, low=50, high=95, scale=256):
    fine = []
    for vec_id, x, label in rows:
        if vec_id is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            fine.append((vec_id, label, [math.floor(scale * c) for c in x]))
    out = []
    for vec_id in sorted({r[0] for r in fine if is_anchor(r[0])}):
        _, label, v = min((r for r in fine if r[0] == vec_id), key=lambda r: r[1:])
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), other, kind) for other, kind, w in fine if other != vec_id and len(w) == len(v))
        for neg, positive, _ in [s for s in scored if s[2] == label][:positives]:
            held = [s for s in scored if s[2] != label and -low * neg <= -100 * s[0] <= -high * neg][:most]
            out += [(vec_id, positive, at + 1, other, -neg, -n) for at, (n, other, _) in enumerate(held)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, several levels of heaps
        monkeypatch.setattr(negatives, "SHARD_ROWS", 7)
        monkeypatch.setattr(negatives, "TILE_ROWS", 3)
        monkeypatch.setattr(negatives, "STEP_ROWS", 2)
        monkeypatch.setattr(negatives, "FAN_IN", 3)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        x = [float(np.float32(c)) for c in rng.integers(-3, 6, 8) / 4]
        rows.append((i, x, int(rng.integers(0, 3))))
    rows += [(300 + i, rows[10][1], i % 2) for i in range(40)]  # one vector under many ids
    rows += [rows[20]] * 30 + [(20, rows[21][1], 2)]  # repeated rows, and an anchor's id with another vector
    rows += [(None, rows[0][1], 1), (401, None, 1), (402, [None] * 8, 1), (403, [float("nan")] + [0.0] * 7, 1), (404, [float("inf")] * 8, 1),
             (405, rows[0][1], None), (410, [1.0, 2.0], 0), (411, [1.0, 1.0], 0), (412, [0.5, 1.0], 1), (420, [], 1), (430, [-1.0] * 8, 9)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, v string")
    mined = negatives.mine(docs, F.col("vec_id") % 10 == 0)
    want = brute(rows, lambda i: i % 10 == 0)
    assert sorted(tuple(r) for r in mined.collect()) == want and len(want) > 50
    assert negatives.mine(docs.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_hot_label_and_other_limits(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.integers(0, 5, 4)], 0 if i % 3 else 1) for i in range(90)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = negatives.mine(docs, F.col("vec_id") < 4, positives=2, negatives=4, low=10, high=100, scale=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i < 4, 2, 4, 10, 100, 3)


def test_no_block_is_broadcast(spark, monkeypatch):
    """Blocks are repeated for their pairs; a broadcast of these would grow with the square of the table, in the driver."""
    monkeypatch.setattr(negatives, "SHARD_ROWS", 16)
    monkeypatch.setattr(negatives, "TILE_ROWS", 8)
    rows = [(i, [float(i % 7), float(i % 5), 1.0], i % 2) for i in range(200)]
    found = negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 10 == 0)
    assert found.count() and found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [tile" not in plan and "SortMergeJoin [tile" in plan
