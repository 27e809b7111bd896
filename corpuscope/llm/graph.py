"""Connected components of an edge table by alternating star steps; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import written

_EDGE = "a long, b long"


class Forest:
    """Union-find over int64 nodes that remembers which edges joined two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            self.edges.append((min(a, b), max(a, b)))

    def take(self) -> pa.RecordBatch | None:
        """The joining edges so far, as one batch; starts anew."""
        edges = np.array(self.edges, np.int64).reshape(-1, 2)
        self.parent, self.edges = {}, []
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"]) if len(edges) else None


#: A forest of so many edges is passed on and a new one begun, so a task's memory has a bound.
FOREST_EDGES = 500_000
#: A node with more edges is dealt over several tasks; of such nodes at most so many are broadcast.
HUB_EDGES, MOST_HUBS = 1024, 100_000


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.edges) >= FOREST_EDGES:
            yield forest.take()
    if (last := forest.take()) is not None:
        yield last


def _with_least(edges: DataFrame, least: DataFrame, node: str, other: str) -> DataFrame:
    """``edges`` with the smallest neighbour m of ``node``; ``least``: (node, m, n), n edges each.

    The edges of a node with more than ``HUB_EDGES`` are dealt over several tasks by ``other``, and its row of ``least`` is repeated for each.
    There are at most edges / ``HUB_EDGES`` hubs; more than ``MOST_HUBS`` are left to the adaptive skew join.
    """
    hubs = least.where(F.col("n") > HUB_EDGES).select(node, F.ceil(F.col("n") / HUB_EDGES).cast("int").alias("k"))
    known = hubs.limit(MOST_HUBS + 1).collect()
    if not 0 < len(known) <= MOST_HUBS:
        return edges.join(least.drop("n"), node)
    hubs = F.broadcast(edges.sparkSession.createDataFrame(known, hubs.schema))
    dealt = edges.join(hubs, node, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("k", F.lit(1)))).drop("k")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("k", F.lit(1)).cast("long") - 1))
    return dealt.join(least.drop("n").join(hubs, node, "left").withColumn("part", parts).drop("k"), [node, "part"]).drop("part")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
    out = _with_least(both.where("b > a"), least, "a", "b")
    return out.select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """b and its smaller neighbours are linked to the smallest of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
    near = _with_least(edges, least, "b", "a").select("a", "b", "m")
    return (
        near.select(F.col("m").alias("x"), F.col("a").alias("y")).where("x < y")
        .union(least.select(F.col("m").alias("x"), F.col("b").alias("y"))).distinct()
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Each round is written to the shared folder. The rounds grow with the logarithm of a component's width. A node with
    very many edges is counted before the shuffle and its rows are dealt over several tasks.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).mapInArrow(_thin, _EDGE), "edges")
    seen = None
    while True:
        now = written(_small_star(written(_large_star(now), "edges")), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
