"""Exact top-k search against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from corpuscope.llm import blocks, topk


def brute(vectors, queries, k):
    out = []
    for q in queries:
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "tile", "fan"), [(4096, 1024, 16), (16, 3, 2)])
def test_blocks_and_merges_equal_brute_force(spark, monkeypatch, shard, tile, fan):
    monkeypatch.setattr(topk, "FAN_IN", fan)
    rng = np.random.default_rng(0)
    vectors = {int(i): rng.integers(-3, 4, 5 if i % 7 else 3).tolist() for i in rng.permutation(130)}  # many ties, two lengths
    frame = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in vectors.items()], "vec_id long, v array<long>")
    got = topk.search(frame, frame.where("vec_id % 10 = 0"), 4, shard, tile).collect()
    assert sorted(tuple(r) for r in got) == brute(vectors, [i for i in vectors if i % 10 == 0], 4)


def test_products_are_exact_when_large():
    q = np.array([[2**40, 2**30]], np.int64)
    v = np.array([[2**20, 1], [2**30, 2**30], [-(2**30), 3]], np.int64)
    assert topk.products(q, v)[0].tolist() == [2**60 + 2**30, 2**63 - 1, -(2**63) + 1]
    small = np.random.default_rng(1).integers(-1000, 1000, (3, 8))
    assert (topk.products(small, small) == small @ small.T).all()
    columns, counts = topk.select_tile(np.array([[2**61, 5, 2**61]]), np.array([[True, False, False]]), 2)
    assert columns[0, :counts[0]].tolist() == [2, 1]


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5], "a"), (100, [1.0, None], "b"), (200, None, "c"), (300, [float("nan"), 1.0], "d"), (400, [float("inf"), 1.0], "e"),
            (5, [0.00098, -0.0001], "f"), (5, [0.00098, -0.0001], "f"), (None, [1.0, 1.0], "g"), (500, [], "h"), (6, [1.0], "i"), (600, [2.0, 2.0], "j")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in topk.search_every(frame, 100).collect())
    assert got == [(0, 1, 600, 3145728), (0, 2, 5, 512), (0, 3, 5, 512), (600, 1, 0, 3145728), (600, 2, 5, 0), (600, 3, 5, 0)]
    assert topk.search_every(frame.limit(0), 100).count() == 0


def test_repeated_ids_and_rows(spark):
    """Each row of a repeated id is a candidate; the id is asked once, with its smallest vector."""
    rows = [(5, [1.0, 1.0]), (5, [2.0, 2.0]), (100, [3.0, 1.0]), (100, [1.0, 0.0]), *[(7, [0.5, 0.5])] * 5000, (200, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(tuple(r) for r in topk.search_every(frame, 100, 4).collect())
    one = 1024 * 1024
    assert got == [
        (100, 1, 5, 2 * one), (100, 2, 5, one), (100, 3, 7, one // 2), (100, 4, 7, one // 2),
        (200, 1, 5, 2 * one), (200, 2, 5, one), (200, 3, 100, one), (200, 4, 7, one // 2)]


def test_no_block_is_broadcast(spark):
    """Blocks are repeated for their pairs; a broadcast of these would grow with the square of the table, in the driver."""
    frame = spark.createDataFrame([(i, [i % 7, i % 5, 1]) for i in range(300)], "vec_id long, v array<long>")
    found = topk.search(frame, frame.where("vec_id % 10 = 0"), 4, 16, 8)
    assert len(found.collect()) == 120
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin [tile" in plan


def test_components_take_no_more_bytes_than_they_need(spark):
    rows = [(0, [1, -1]), (1, [200, 1]), (2, [1 << 20, 1]), (3, [1 << 40, 1])]
    for row, width in zip(rows, (1, 2, 4, 8), strict=True):
        block = blocks.cut_blocks(spark.createDataFrame([row], "vec_id long, v array<long>"), 8, 1).first()
        assert (block.width, len(block.data)) == (width, 2 * width)
        assert blocks.ints(block.data, 1, 2, width=block.width).tolist() == [row[1]]
