"""Connected components against union-find."""

from __future__ import annotations

import random

import pytest

from corpuscope.llm import graph


@pytest.mark.parametrize(("hub", "most"), [(1024, 100_000), (3, 100_000), (3, 2)])
def test_components_of_paths_stars_and_random_edges(spark, monkeypatch, hub, most):
    monkeypatch.setattr(graph, "HUB_EDGES", hub)
    monkeypatch.setattr(graph, "MOST_HUBS", most)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(-5, -9), (-9, -5), (7, 7)]
    edges += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    rng.shuffle(edges)
    forest = graph.Forest()
    for a, b in edges:
        forest.join(a, b)
    rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {x: forest.root(x) for e in edges for x in e if e[0] != e[1]}
    got = {r.node: r.root for r in rows}
    assert {x: got.get(x, x) for x in want} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
