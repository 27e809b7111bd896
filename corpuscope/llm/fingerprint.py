"""Improbable-feature digests of documents (operator 2).

Every 64-byte window of a text has an entropy level; levels are ranked by how rare they are over all documents. In each run of
64 neighbouring windows the leftmost one of the rarest level scores; windows that score often are the
text's features. They are inserted into a chain of Bloom filters, and two chains are compared by their common bits,
normalised between what chance gives and what is possible.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import map_batches, regroup, text_bytes

WINDOW = 64
#: Windows that compete with each other, and the wins that make a feature.
RUN, WINS = 64, 16
LEVELS = 1000
#: Windows below this level (runs of few different bytes) tell nothing.
LEAST_LEVEL = 100
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Overlap beyond chance that counts as none: a share of the possible, and so many standard deviations.
SHARE, DEVIATIONS = 0.1, 3.0
#: Range buckets for each shuffle partition, and their most.
BUCKETS_EACH, MOST_BUCKETS = 4, 20_000
_CHUNK = 1 << 18
_OUT = (LEVELS + 1) + 1  # rank of windows that take no part
_SCALE = 1 << 16


def _gain() -> np.ndarray:
    count = np.arange(WINDOW + 1)
    weight = np.zeros(WINDOW + 1, np.int64)
    weight[1:] = np.round(count[1:] * np.log2(count[1:]) * _SCALE).astype(np.int64)
    gain = np.zeros(WINDOW + 1, np.int32)
    gain[1:] = np.diff(weight)
    return gain


_GAIN = _gain()


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy level, 0 to ``LEVELS``, of the window at each position (len - 63 of them).

    A window's sum of c log c changes by the count of the byte that leaves and of the one that comes; both counts
    come from 63 shifted comparisons of the whole array.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    back, ahead = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        back[k:] += same
        ahead[:-k] += same
    first = _GAIN.cumsum()[np.bincount(data[:WINDOW], minlength=256)].sum()
    total = np.empty(n - WINDOW + 1, np.int32)
    total[0] = first
    total[1:] = _GAIN[back[WINDOW:]] - _GAIN[ahead[:n - WINDOW]]
    np.cumsum(total, out=total)
    return LEVELS - (total.astype(np.int64) * LEVELS // (WINDOW * 6 * _SCALE)).astype(np.int32)


def wins(ranks: np.ndarray) -> np.ndarray:
    """How many runs of ``RUN`` neighbouring windows each window wins. Runs may hang over the ends."""
    pad = np.full(RUN - 1, _OUT, np.int32)
    key = np.concatenate([pad, ranks, pad]) << 20 | np.arange(len(ranks) + 2 * RUN - 2, dtype=np.int32)
    step = 1
    while step < RUN:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    best = key & ((1 << 20) - 1)
    return np.bincount(best[(key >> 20) < _OUT] - (RUN - 1), minlength=len(ranks))


def _mixed(windows: np.ndarray) -> np.ndarray:
    """64-bit hash of each 64-byte row."""
    out = np.full(len(windows), 0x27D4EB2F165667C5, np.uint64)
    for word in np.ascontiguousarray(windows).view("<u8").T:
        out = (out ^ word) * np.uint64(0x9E3779B185EBCA87)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xC2B2AE3D27D4EB4F) ^ out >> np.uint64(32)


def _features(data: np.ndarray, bounds: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, wins, hash) of all windows that win at least once, in order, for texts side by side in ``data``.

    Slices overlap by what a window's rank and its runs need, so a long text gives the same features however it is cut.
    """
    n = len(data)
    ends = bounds[1:]
    for at in range(0, max(0, n - WINDOW + 1), _CHUNK):
        lo, hi = max(0, at - RUN + 1), min(n - WINDOW + 1, at + _CHUNK + RUN - 1)
        row = np.searchsorted(ends, np.arange(lo, hi), "right")
        here = ranks[levels(data[lo:hi + WINDOW - 1])]
        here[ends[row] - np.arange(lo, hi) < WINDOW] = _OUT  # windows over the end of a text
        won = wins(here)
        own = np.flatnonzero(won)
        own = own[(own + lo >= at) & (own + lo < at + _CHUNK)]
        views = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
        yield row[own], won[own], _mixed(views[own + lo])


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Bloom filters of each text, (filters, 256) bytes; an empty text has none.

    A text without a window that wins ``WINS`` runs takes its best window; one without any window of enough entropy, and one
    of under 64 bytes, is a single feature itself.
    """
    bounds = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    parts = list(_features(np.frombuffer(b"".join(texts), np.uint8), bounds, ranks))
    rows, won, hashes = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, rows, won)
    weak = (most > 0) & (most < WINS)
    keep = won >= WINS
    if weak.any():
        best = np.flatnonzero(weak[rows] & (won == most[rows]))
        keep[best[np.unique(rows[best], return_index=True)[1]]] = True
    rows, hashes = rows[keep], hashes[keep]
    whole = [i for i, t in enumerate(texts) if t and not most[i]]
    if whole:
        rows = np.append(rows, whole)
        hashes = np.append(hashes, np.array([xxhash.xxh64_intdigest(texts[i]) for i in whole], np.uint64))
        order = np.argsort(rows, kind="stable")
        rows, hashes = rows[order], hashes[order]
    counts = np.bincount(rows, minlength=len(texts))
    filters = -(-counts // FILTER_FEATURES)
    base = np.append(0, np.cumsum(filters))
    nth = np.arange(len(rows)) - np.append(0, np.cumsum(counts))[rows]
    number = base[rows] + nth // FILTER_FEATURES
    bits = np.zeros((int(base[-1]), FILTER_BITS), bool)
    for k in range(HASHES):
        bits[number, ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1) if len(bits) else np.zeros((0, FILTER_BITS // 8), np.uint8)
    return [packed[base[i]:base[i + 1]] for i in range(len(texts))]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain against its best match in the other one, weighted by its bits. Equal chains give
    1, an empty and another one 0."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    other = b.view("<u8")
    size_b = np.bitwise_count(other).sum(axis=1, dtype=np.int64)
    score = weight = 0.0
    for one in a.view("<u8"):
        size = int(np.bitwise_count(one).sum())
        best = 0.0
        for at in range(0, len(other), 4096):
            common = np.bitwise_count(other[at:at + 4096] & one).sum(axis=1, dtype=np.int64)
            sizes = size_b[at:at + 4096]
            chance = size * sizes / FILTER_BITS
            most = np.minimum(size, sizes)
            spread = np.sqrt(chance * (1 - size / FILTER_BITS) * (1 - sizes / FILTER_BITS))
            cut = chance + np.maximum(SHARE * (most - chance), DEVIATIONS * spread)
            value = np.where(common >= most, 1.0, np.where(common > cut, (common - cut) / np.maximum(most - cut, 1e-9), 0.0))
            best = max(best, float(np.clip(value, 0, 1).max()))
        score += size * best
        weight += size
    return score / weight


def as_text(filters: np.ndarray) -> str:
    """Number of filters, colon, base64 of their bits."""
    return f"{len(filters)}:{base64.b64encode(filters.tobytes()).decode()}"


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text.partition(":")[2]), np.uint8).reshape(-1, FILTER_BITS // 8)


def level_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy level, rarest first, from all windows of all documents; levels too low take no part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for table in regroup(batches, 4 << 20):
            data, bounds = text_bytes(table.column("text"))
            ends = bounds[1:]
            for at in range(0, max(0, len(data) - WINDOW + 1), _CHUNK):
                hi = min(len(data) - WINDOW + 1, at + _CHUNK)
                place = np.arange(at, hi)
                whole = ends[np.searchsorted(ends, place, "right")] - place >= WINDOW
                total += np.bincount(levels(data[at:hi + WINDOW - 1])[whole], minlength=LEVELS + 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"level": pa.array(seen.astype(np.int32)), "n": pa.array(total[seen])})

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS + 1, np.int64)
    for r in rows:
        counts[r["level"]] = r["n"]
    ranks = np.empty(LEVELS + 1, np.int32)
    ranks[np.lexsort((np.arange(LEVELS + 1), counts))] = np.arange(LEVELS + 1)
    ranks[:LEAST_LEVEL] = _OUT
    return ranks


def fingerprints(docs: DataFrame, ranks: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row. No shuffle."""

    def run(table: pa.Table) -> pa.Table:
        found = digests([(t or "").encode() for t in table.column("text").to_pylist()], ranks)
        return pa.table({"doc_id": table.column("doc_id"), "fingerprint": pa.array([as_text(f) for f in found], pa.string())})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string", most_bytes=4 << 20)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by as many of the following text, or by all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pair_up(ranks: np.ndarray):
    def finish(rows: list[tuple], prints: list[np.ndarray | None]) -> pa.RecordBatch | None:
        """Results of all own rows but the last; rows follow each other in document order."""
        todo = [i for i in range(len(rows) - 1) if rows[i][1]]
        changed = [edited(rows[i][3], rows[i + 1][3]).encode() for i in todo]
        new = [i for i, p in enumerate(prints) if p is None]
        both = digests([rows[i][3].encode() for i in new] + changed, ranks)
        for i, p in zip(new, both, strict=False):
            prints[i] = p
        after = both[len(new):]
        if not todo:
            return None
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([rows[i][2] for i in todo], pa.int64()),
            "n_chars": pa.array([len(rows[i][3]) for i in todo], pa.int64()),
            "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
            "fingerprint": [as_text(prints[i]) for i in todo],
            "edited_fingerprint": [as_text(p) for p in after],
            "near_edited": [likeness(prints[i], p) for i, p in zip(todo, after, strict=True)],
            "near_next": [likeness(prints[i], prints[i + 1]) for i in todo],
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        prints: list[np.ndarray | None] = []
        for table in regroup(batches, 4 << 20):
            columns = [table.column(c).to_pylist() for c in ("bucket", "own", "doc_id", "text")]
            rows += [(b, o, d, t or "") for b, o, d, t in zip(*columns, strict=True)]
            prints += [None] * table.num_rows
            if (out := finish(rows, prints)) is not None:
                yield out
            rows, prints = rows[-1:], prints[-1:]

    return run


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: n_chars, the digest of the edited text, both fingerprints, and the likeness to the edited text and to the next
    document (ascending id, after the last the first; rows of one id in order of their text's hash; null ids come first).

    Null reads as empty. Ids are cut into range buckets at ids that exist, so the first document of each bucket is known and goes to
    the bucket before it too. The texts are shuffled once; a task sorts its buckets and walks them with one row of memory.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit(-(2**63))))
    ranks = level_ranks(rows)
    buckets = min(MOST_BUCKETS, BUCKETS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / buckets for k in range(buckets)]
    found = rows.agg(F.min("place").alias("least"), F.percentile_approx("place", shares, 10 * buckets).alias("cuts")).first()
    cuts = np.unique(np.array([found["least"], *(found["cuts"] or [])], np.int64)) if found["least"] is not None else np.zeros(1, np.int64)

    @F.pandas_udf("array<int>")
    def slots(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for places in batches:
            values = places.to_numpy(np.int64)
            own = np.searchsorted(cuts, values, "right") - 1
            first = cuts[own] == values
            yield pd.Series([[b, (b - 1) % len(cuts)] if f else [b] for b, f in zip(own.tolist(), first.tolist(), strict=True)])

    dealt = rows.withColumn("slots", slots("place")).select("doc_id", "place", "text", F.posexplode("slots").alias("nth", "bucket"))
    ordered = (
        dealt.select("bucket", (F.col("nth") == 0).alias("own"), "doc_id", "place", "text")
        .repartition("bucket").sortWithinPartitions("bucket", F.desc("own"), "place", F.xxhash64("text"))
    )
    return ordered.select("bucket", "own", "doc_id", "text").mapInArrow(_pair_up(ranks), _PAIRED)
