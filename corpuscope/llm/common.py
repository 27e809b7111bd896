"""Helpers of this subpackage: the shared folder, written tables, published files, Arrow text buffers."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Regex, pre_tokenizers

CHUNK_BYTES = 4 << 20
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master without that setting gets a scratch folder."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: later steps neither repeat the work
    nor need the executors that did it."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def publish(spark: SparkSession, name: str, payload: bytes) -> str:
    """Store a file in the shared folder and let Spark hand it to every executor, later ones included.

    Returns the name for ``published``. The name holds a digest, so equal payloads share one file.
    """
    name = f"{name}-{hashlib.sha256(payload).hexdigest()[:20]}.bin"
    uri = f"{shared_folder(spark)}/llm/files-{spark.sparkContext.applicationId}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):  # handed out before: one name has one path
        return name
    out = fs.create(path, True)
    try:
        for at in range(0, len(payload), CHUNK_BYTES):
            out.write(payload[at:at + CHUNK_BYTES])
    finally:
        out.close()
    spark.sparkContext.addFile(uri)
    return name


def published(name: str) -> str:
    """Path of a published file on this machine."""
    return SparkFiles.get(name)


def map_batches(df: DataFrame, fn: Callable[[pa.Table], pa.Table | None], schema: StructType | str,
                most_bytes: int = BATCH_BYTES, setup: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` with batches of about ``most_bytes``: small ones are joined, large ones are cut by rows.

    Memory of a task follows ``most_bytes`` (or the longest single row), not the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup:
            setup()
        for table in regroup(batches, most_bytes):
            out = fn(table)
            if out is not None and out.num_rows:
                yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return unused memory at the end of a task: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def regroup(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = max(1, batch.nbytes)
        step = max(1, int(batch.num_rows * most_bytes / whole)) if whole > most_bytes else batch.num_rows
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            size += part.nbytes
            if size >= most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the n + 1 bounds of the rows. Null reads as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0) if array.num_chunks else pa.array([], pa.string())
    array = array.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    data = array.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = (int(bounds[0]), int(bounds[-1])) if len(bounds) else (0, 0)
    return flat[lo:hi], (bounds - lo if len(bounds) else np.zeros(1, np.int64))


def most_frequent(counts: DataFrame, value: str, most: int) -> DataFrame:
    """Rows of ``counts`` with the highest values, at most ``most`` of them; rows of the value at the cut are left out together.

    The cut is found from how many rows have each value, so what reaches the driver doesn't grow with the partitions.
    """
    sizes = counts.groupBy(value).agg(F.count("*").alias("_rows")).orderBy(F.desc(value)).limit(most).collect()
    total, cut = 0, None
    for r in sizes:
        total += r["_rows"]
        if total > most:
            break
        cut = r[value]
    return counts.limit(0) if cut is None else counts.where(F.col(value) >= F.lit(cut))


#: The bytes that separate words, space and \t \n \v \f \r.
WORD_BREAKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(WORD_BREAKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bytes(flat: np.ndarray) -> np.ndarray:
    """Marks the bytes that belong to words ``[^\\x20\\x09-\\x0D]+``."""
    return ~_IS_BREAK[flat]


def ascii_words(column: pa.ChunkedArray | pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts, A-Z lower-cased if asked for, and the n + 1 bounds of each row's words."""
    flat, bounds = text_bytes(column)
    n = len(flat)
    if not n:
        return pa.array([], pa.large_binary()), np.zeros(len(bounds), np.int64)
    inside = word_bytes(flat)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < n]  # a row's first byte starts a word whatever stands before it
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    kept = flat[inside]
    if lower:
        kept = _LOWER[kept]
    place = np.cumsum(inside)
    offsets = np.append(place[starts] - 1, len(kept)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return words, np.searchsorted(starts, bounds)


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each row's bounds; empty rows give 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of each code point: 1 letter (L*), 2 number (N*), 3 white space, else 0.

    Unicode versions differ between libraries; the code points that are new in one follow the installed tokenizers library,
    whose results have to be matched.
    """
    kinds = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for run in regex.finditer(pattern, every):
            kinds[run.start():run.end()] = kind
    kinds[0xD800:0xE000] = 0
    known = {"L": 1, "N": 2}
    unsure = [c for c in np.flatnonzero((kinds == 1) | (kinds == 2)).tolist() if known.get(unicodedata.category(chr(c))[0]) != kinds[c]]
    text = " ".join(map(chr, unsure))
    kinds[unsure] = 0
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+")):
        for piece, _ in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            kinds[[ord(c) for c in piece]] = kind
    return kinds


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return character_classes() == 1


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after another, and the n + 1 bounds of the texts."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def row_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Marks the first code point of every text that has one."""
    first = np.zeros(n, bool)
    first[bounds[:-1][bounds[:-1] < n]] = True
    return first


#: The contractions that the public tokenizers' patterns split off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def split_contractions(points: np.ndarray, kinds: np.ndarray, first: np.ndarray, starts: np.ndarray, quotes: np.ndarray) -> None:
    """Move token starts so that a contraction at each of ``quotes`` (token starts at an apostrophe that a letter follows) is one token."""
    n = len(points)
    after = lambda at: (at < n) & ~first[np.minimum(at, n - 1)] & (kinds[np.minimum(at, n - 1)] == 1)
    one = points[np.minimum(quotes + 1, n - 1)]
    two = np.where(after(quotes + 2), points[np.minimum(quotes + 2, n - 1)], 0)
    length = np.zeros(len(quotes), np.int64)
    for text in CONTRACTIONS:
        fits = one == ord(text[1])
        if len(text) == 3:
            fits &= two == ord(text[2])
        length[fits & (length == 0)] = len(text)
    for size in (2, 3):
        at = quotes[length == size]
        starts[at + 1] = False
        if size == 3:
            starts[at + 2] = False
        rest = at + size
        rest = rest[after(rest)]
        starts[rest] = True


def tokens_as_binary(points: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Tokens in UTF-8: each runs from a start to the next; code points outside ``inside`` are left out."""
    kept = points[inside]
    data = kept.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    width = (kept >= 0x80).astype(np.uint8)
    width += kept >= 0x800
    width += kept >= 0x10000
    width += 1
    ends = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    offsets = np.append(ends[np.flatnonzero(starts[inside])], ends[-1]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def take_ragged(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the given rows of a ragged array, one after another, and their bounds."""
    sizes = (bounds[1:] - bounds[:-1])[rows]
    out = np.append(0, np.cumsum(sizes))
    return values[np.arange(out[-1]) + np.repeat(bounds[:-1][rows] - out[:-1], sizes)], out
