"""Exact top-k inner-product search (operator 5).

Vectors and queries are cut into blocks (shards and query tiles). Each pair of a tile and a shard is one matrix
product; of each product only every query's best k stay (partial selection), and these short lists are merged per
query level by level. No list grows past ``FAN_IN * k``, no vector leaves its block pair, and nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.blocks import block_pairs, cut_blocks, each_row, ints
from corpuscope.llm.common import written

SHARD_ROWS = 4096
TILE_ROWS = 16384
#: Queries of a tile that are multiplied at once, so that the scores of a step stay small.
STEP_ROWS = 1024
FAN_IN = 16
_BEST = "query_id long, shard long, best array<struct<neg:long,vec_id:long>>"


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int = 1024, copies: int = 1) -> DataFrame:
    """(vec_id long, v array<long>, copy long): ``floor(scale * x)`` as double. Rows with a null id, a null vector, or a null or
    non-finite component are left out. Rows of one id with different vectors all stay; of equal rows at most ``copies`` do."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = (
        vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull())
        .select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(fine)
        .select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))
    )
    each = F.sequence(F.lit(1).cast("long"), F.least("count", F.lit(copies).cast("long")))
    return rows.groupBy("vec_id", "v").count().select("vec_id", "v", F.explode(each).alias("copy"))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products. Float64 matrix products are exact below 2^53; larger values go through
    Python integers and are held to the range of a long."""
    high = lambda a: int(np.abs(a.astype(np.float64)).max()) if a.size else 0
    if high(queries) * high(vectors) * max(1, queries.shape[1]) < 2**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def select_tile(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Column numbers of each row's k best scores, best first and ties to the smaller column; ``own`` marks cells that
    take no part. Returns (columns, how many of them count)."""
    n = scores.shape[1]
    counts = n - own.sum(axis=1)
    k = min(k, n)
    low, high = (int(scores.min()), int(scores.max())) if scores.size else (0, 0)
    if (max(abs(low), abs(high)) + 1) * (n + 1) * 2 < 2**62:
        key = scores * n + (n - 1 - np.arange(n))
        key[own] = -(2**62)
        part = np.argpartition(key, n - k, axis=1)[:, n - k:]
        order = np.argsort(-np.take_along_axis(key, part, axis=1), axis=1, kind="stable")
        return np.take_along_axis(part, order, axis=1), np.minimum(counts, k)
    columns = np.empty((len(scores), k), np.int64)
    for i, row in enumerate(scores):
        columns[i] = np.lexsort((np.arange(n), ~row, own[i]))[:k]
    return columns, np.minimum(counts, k)


def _multiply(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            asked, vid = ints(row["a_ids"]), ints(row["ids"])
            queries = ints(row["a_data"], len(asked), row["dim"], width=row["a_width"])
            vectors = ints(row["data"], len(vid), row["dim"], width=row["width"])
            for at in range(0, len(asked), STEP_ROWS):
                qid = asked[at:at + STEP_ROWS]
                scores = products(queries[at:at + STEP_ROWS], vectors)
                columns, counts = select_tile(scores, qid[:, None] == vid[None, :], k)
                kept = np.arange(columns.shape[1])[None, :] < counts[:, None]
                best = pa.StructArray.from_arrays(
                    [pa.array(-np.take_along_axis(scores, columns, axis=1)[kept]), pa.array(vid[columns[kept]])], ["neg", "vec_id"])
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qid), pa.array(np.full(len(qid), row["part"])), pa.ListArray.from_arrays(pa.array(offsets), best)],
                    ["query_id", "shard", "best"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS,
           tile_rows: int = TILE_ROWS) -> DataFrame:
    """The k best vectors of each query: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    Both inputs are (vec_id long, v array<long>), as ``quantised`` gives; queries have one row for each id, vectors may have several,
    which all take part. A query finds no row of its own id; vectors of another length take none either, so a query without partners has no rows. Empty
    tables give no rows. Work is one product for each pair of blocks, which any number of executors share; neither side is broadcast.
    """
    count = vectors.count()
    shards = max(1, -(-count // shard_rows))
    tiles = max(1, -(-queries.count() // tile_rows))
    base, asked = cut_blocks(vectors, shard_rows * 2, shards), cut_blocks(queries, tile_rows * 2, tiles)
    best = block_pairs(base, shards, asked, tiles).mapInArrow(_multiply(k), _BEST)
    while True:
        shards = -(-shards // FAN_IN)
        best = (
            best.groupBy("query_id", F.floor(F.col("shard") / FAN_IN).alias("shard"))
            .agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        )
        if shards == 1:
            break
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.neg")).alias("score"))


def search_every(vectors: DataFrame, step: int, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Queries are the ids divisible by ``step``; candidates are all rows but the query's own. An id that repeats is asked once, with its
    smallest vector, and none of its rows is a candidate of its own; for all others each of its rows is one."""
    table = written(quantised(vectors, vec_id, embedding, copies=k), "vectors")  # k equal rows fill a list
    asked = table.where(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    return search(table, asked, k)
