"""Blocks of integer vectors and their pairs, for products of all with all (operators 5 and 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block of long vectors holds fewer rows.
BLOCK_BYTES = 16 << 20
#: Pairs are dealt to at most so many tasks.
MOST_TASKS = 2000


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the shortest type that holds them all."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def cut_blocks(vectors: DataFrame, rows: int, parts: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of at most ``rows`` vectors of one length, in id order within a block: part, dim, ids and the columns ``more`` (long or
    array<long>) as int64, and the components as integers of ``width`` bytes. Rows are dealt by a hash of the whole row."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = _joined(held)
        ids = batch.column("vec_id").to_numpy()
        lists = batch.column("v")
        lengths = np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset:lists.offset + len(lists) + 1])
        for dim in np.unique(lengths):
            here = np.flatnonzero(lengths == dim)
            here = pa.array(here[np.argsort(ids[here], kind="stable")])
            data = _narrow(lists.take(here).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            extra = {c: batch.column(c).take(here) for c in more}
            raw = {c: (a.flatten() if pa.types.is_list(a.type) else a).to_numpy(zero_copy_only=False).astype(np.int64) for c, a in extra.items()}
            yield pa.RecordBatch.from_pydict({
                "part": batch.column("part").slice(0, 1).cast(pa.int64()), "dim": pa.array([int(dim)], pa.int32()),
                "width": pa.array([data.itemsize], pa.int32()),
                **{c: pa.array([a.tobytes()], pa.binary()) for c, a in {"ids": ids[here.to_numpy()].astype(np.int64), "data": data, **raw}.items()},
            })

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by part: cut where the part changes or a block is full
            part = batch.column("part").to_numpy()
            for piece in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                if held and held[0].column("part")[0].as_py() != part[piece[0]]:
                    yield from cut(held)
                    held = []
                for at in range(0, len(piece), rows):
                    held.append(batch.slice(int(piece[at]), len(piece[at:at + rows])))
                    if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= BLOCK_BYTES:
                        yield from cut(held)
                        held = []
        if held:
            yield from cut(held)

    dealt = vectors.select("vec_id", "v", *more, F.pmod(F.xxhash64(*vectors.columns), F.lit(parts)).alias("part"))  # rows of one id apart
    kinds = ", ".join(f"{c} binary" for c in ("ids", "data", *more))
    return dealt.repartition("part").sortWithinPartitions("part", "vec_id").mapInArrow(grouped, f"part long, dim int, width int, {kinds}")


def block_pairs(base: DataFrame, shards: int, asked: DataFrame, tiles: int) -> DataFrame:
    """Each block of ``base`` beside each of ``asked`` with vectors of its length, whose columns are named ``a_*``.

    Blocks are repeated for their pairs, and either side of that join grows with the square of the table: it must be merged, as a
    broadcast would pass all of a side through the driver. A pair is dealt by its own key, whatever its size, for the work is in the product.
    """
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    columns = [F.col(c).alias(f"a_{c}") for c in asked.columns if c not in ("part", "dim")]
    asked = asked.select(F.col("part").alias("tile"), "dim", *columns, each(shards).alias("part"))
    key, tasks = ["tile", "part", "dim"], min(shards * tiles, MOST_TASKS)
    return base.withColumn("tile", each(tiles)).repartition(tasks, *key).hint("merge").join(asked.repartition(tasks, *key), key)


def ints(raw: bytes, *shape: int, width: int = 8) -> np.ndarray:
    values = np.frombuffer(raw, f"i{width}").astype(np.int64, copy=False)
    return values.reshape(shape) if shape else values


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dicts, of which one at a time is held."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]
