"""Hard-negative mining by Strassen products of anchor and candidate tiles (operator 12).

Anchors and candidates are cut into blocks; each pair of blocks is one integer product by Strassen's recursion with zero padding. Of a
product only short heaps stay, per anchor the best positives and, once these are known, per positive the best cells of its
score window. Heaps of different blocks are merged level by level. Each heap is a sorted array, best first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.blocks import BLOCK_BYTES, block_pairs, cut_blocks, each_row, ints
from corpuscope.llm.common import written

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
TILE_ROWS, SHARD_ROWS = 8192, 4096
#: Anchors of a tile that are multiplied at once, so that the scores of a step stay small.
STEP_ROWS = 512
#: A product with a side of at most so many cells is not split further.
LEAF = 32
FAN_IN = 16
_HEAP = "array<struct<neg:long,vec_id:long>>"
_LEAST = -(2**63)


def _high(a: np.ndarray) -> int:
    return max(abs(int(a.min())), abs(int(a.max()))) if a.size else 0


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype != object and _high(a) * _high(b) * max(1, a.shape[1]) < 2**53:  # exact in float64
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _padded(a: np.ndarray) -> np.ndarray:
    """``a`` with a row or column of zeros where a side is odd."""
    odd = (a.shape[0] % 2, a.shape[1] % 2)
    return np.pad(a, ((0, odd[0]), (0, odd[1]))) if any(odd) else a


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two matrices of int64 or of Python integers by seven products of quarters. Additions are exact: int64 wraps
    around alike in every step, so results that fit are right."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return _leaf(a, b)
    a, b = _padded(a), _padded(b)
    r, s, t = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * r, 2 * t), a.dtype)
    out[:r, :t] = p1 + p4 - p5 + p7
    out[:r, t:] = p3 + p5
    out[r:, :t] = p2 + p4
    out[r:, t:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def scores_of(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of all anchors with all rows. Where int64 could overflow, Python integers are multiplied and results held to the
    range of a long."""
    if _high(anchors) * _high(rows) * max(1, rows.shape[1]) < 2**62:
        return strassen(anchors, np.ascontiguousarray(rows.T))
    exact = strassen(anchors.astype(object), rows.T.astype(object))
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def best_cells(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of each row's k best allowed cells, by row, best first; ties to the smaller column."""
    n = scores.shape[1]
    kept = allowed
    if n > k:
        held = np.where(allowed, scores, _LEAST)
        kept = allowed & (held >= np.partition(held, n - k, axis=1)[:, n - k, None])
    rows, columns = np.nonzero(kept)
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, np.arange(len(scores)))
    fits = np.arange(len(rows)) - first[rows] < k
    return rows[fits], columns[fits]


def _heaps(rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Numbers of the rows that have cells, and their heaps."""
    owners, counts = np.unique(rows, return_counts=True)
    cells = pa.StructArray.from_arrays([pa.array(-scores[rows, columns]), pa.array(ids[columns])], ["neg", "vec_id"])
    return owners, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), cells)


def quantised(vectors: DataFrame, vec_id: str, embedding: str, label: Column, scale: int, copies: int) -> DataFrame:
    """(vec_id long, label long, v array<long>): ``floor(scale * x)`` as double. Rows with a null id, label or vector, or with a null or
    non-finite component are left out. Of equal rows at most ``copies`` stay, as more can't be in one result."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    rows = rows.where("vec_id is not null and label is not null and x is not null").where(fine)
    rows = rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))
    counted = rows.groupBy("vec_id", "label", "v").count()
    each = F.sequence(F.lit(1).cast("long"), F.least("count", F.lit(copies).cast("long")))
    return counted.select("vec_id", "label", "v", F.explode(each).alias("copy"))


def _steps(batches: Iterator[pa.RecordBatch], width: int):
    """For each step of each pair of blocks: shard, anchor ids and windows, candidate ids, scores, and which cells are other rows of the
    same or another label."""
    for row in each_row(batches):
        dim, ids, labels = row["dim"], ints(row["ids"]), ints(row["label"])
        data, asked, own = ints(row["data"], len(ids), dim, width=row["width"]), ints(row["a_ids"]), ints(row["a_label"])
        anchors, windows = ints(row["a_data"], len(asked), dim, width=row["a_width"]), ints(row["a_windows"], len(asked), width)
        for at in range(0, len(asked), STEP_ROWS):
            part = slice(at, at + STEP_ROWS)
            other = asked[part, None] != ids[None, :]
            same = own[part, None] == labels[None, :]
            yield row["part"], asked[part], windows[part], ids, scores_of(anchors[part], data), other & same, other & ~same


def _positives(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, asked, _, ids, scores, same, _ in _steps(batches, 1):
            owners, heaps = _heaps(*best_cells(scores, same, most), scores, ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(asked[owners]), pa.array(np.zeros(len(owners), np.int32)), pa.array(np.full(len(owners), shard)), heaps],
                ["anchor_id", "place", "shard", "heap"])

    return run


def _windows(most: int, width: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, asked, windows, ids, scores, _, different in _steps(batches, width):
            for place in range(width):
                limit = windows[:, place].astype(object)  # the least long: no such positive
                least = np.array([-((-low * int(x)) // 100) for x in limit], object)
                most_score = np.array([(high * int(x)) // 100 for x in limit], object)
                given = windows[:, place] != _LEAST
                least, most_score = (np.clip(y, _LEAST + 1, 2**63 - 1).astype(np.int64)[:, None] for y in (least, most_score))
                owners, heaps = _heaps(*best_cells(scores, different & (scores >= least) & (scores <= most_score) & given[:, None], most), scores, ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked[owners]), pa.array(np.full(len(owners), place, np.int32)), pa.array(np.full(len(owners), shard)), heaps],
                    ["anchor_id", "place", "shard", "heap"])

    return run


def _pairs(base: DataFrame, shards: int, anchors: DataFrame, tiles: int) -> DataFrame:
    return block_pairs(base, shards, cut_blocks(anchors, 2 * TILE_ROWS, tiles, ("label", "windows")), tiles)


def _merged(heaps: DataFrame, shards: int, most: int) -> DataFrame:
    """(anchor_id, place, heap): of ``FAN_IN`` heaps at a time the best ``most`` entries stay."""
    while True:
        shards = -(-shards // FAN_IN)
        heaps = heaps.groupBy("anchor_id", "place", F.floor(F.col("shard") / FAN_IN).alias("shard")).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("heap"))), 1, most).alias("heap"))
        if shards == 1:
            return heaps.drop("shard")


def mine(vectors: DataFrame, anchors: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: Column | str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the column ``vec_id``. Scores are integer inner products with the anchor of components
    ``floor(scale * x)``; higher ones come first, ties by the smaller id. Positives are the first rows of the anchor's label,
    negatives for a positive the first rows of another label with ``low`` to ``high`` percent of the positive's score. Rows
    with nulls or non-finite components take no part; vectors of different lengths none with each other. Repeated rows all take
    part. An id that repeats among the anchors is asked once, with its smallest (label, vector), and rows of the anchor's own id are
    never its partners. Empty tables give no rows. Work is two products for each pair of blocks, which any number of executors share; no block is broadcast.
    """
    label = F.col(label) if isinstance(label, str) else label
    table = written(quantised(vectors, vec_id, embedding, label, scale, max(positives, negatives)), "vectors")
    kinds = "anchor_id long, place int, shard long, heap " + _HEAP
    count, longest = table.agg(F.count("*"), F.max(F.size("v"))).first()
    fits = max(1, BLOCK_BYTES // (8 * max(1, longest or 1)))
    shards = max(1, -(-count // min(SHARD_ROWS, fits)))
    asked = table.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("own"))
    asked = asked.select("vec_id", "own.*", F.lit(1).cast("long").alias("copy"))
    tiles = max(1, -(-asked.count() // min(TILE_ROWS, fits)))
    none = F.array(F.lit(_LEAST).cast("long"))
    base = written(cut_blocks(table, 2 * SHARD_ROWS, shards, ("label",)), "blocks")
    first = _pairs(base, shards, asked.withColumn("windows", none), tiles).mapInArrow(_positives(positives), kinds)
    found = written(_merged(first, shards, positives), "positives")
    values = F.transform("heap", lambda c: -c["neg"])
    limits = F.concat(values, F.array_repeat(F.lit(_LEAST).cast("long"), F.lit(positives) - F.size("heap")))
    windows = asked.join(found.select(F.col("anchor_id").alias("vec_id"), limits.alias("windows")), "vec_id")
    second = _pairs(base, shards, windows, tiles).mapInArrow(_windows(negatives, positives, low, high), kinds)
    mined = _merged(second, shards, negatives)
    pairs = found.select("anchor_id", F.posexplode("heap").alias("place", "p"))
    return mined.join(pairs, ["anchor_id", "place"]).select("anchor_id", "p", F.posexplode("heap").alias("at", "n")).select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"),
        (-F.col("p.neg")).alias("positive_score"), (-F.col("n.neg")).alias("negative_score"))
