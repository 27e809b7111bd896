"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 4).

A 64-bit fingerprint is cut into three segments (22, 21, 21 bits), read as 23-bit words of the binary Golay code. The
code is perfect with radius 3: a word has one codeword within 3 bits, and where that is at distance 3 there are five
more at distance 4. A word's keys are the indices of its codewords within 4 bits (1 or 6). Words that differ in at
most one bit share a key: the nearest codeword of one is within 4 bits of the other.

Three differing bits fall on three segments as (0, at most 1, any) in some order, or as (1, 1, 1). So two families of
keys find every pair: one segment whole with the codeword index of another, and the codeword indices of the first two
segments with one half of the third. Fingerprints that share a key meet in a bucket and are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import map_batches, written
from corpuscope.llm.graph import FOREST_EDGES, Forest, components

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Fixed value: generator polynomial of the (23, 12) Golay code.
GOLAY = 0xC75
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A bucket of more fingerprints is compared in block pairs by many tasks.
BUCKET_ROWS = 1 << 16
#: Buckets of up to this size are compared in one vectorised pass over the whole batch.
SMALL = 24


def fingerprint(text: str | None) -> int:
    """SimHash of the 3-word shingles: a bit is set if more than half of the shingles' hashes have it. Fewer words: the
    whole sequence is one shingle; no word or null: zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = ends[SHINGLE - 1:] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), last.tolist())), np.uint64, len(last))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, fp long): one row for each row of ``docs``; fp holds the 64 bits."""

    def run(table: pa.Table) -> pa.Table:
        prints = np.array([fingerprint(t) for t in table.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.table({"doc_id": table.column("doc_id"), "fp": pa.array(prints)})

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, fp long")


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 bits; for each syndrome up to 6 error patterns, and how many there are."""
    upper = np.zeros(4096, np.int64)
    for i in range(4096):
        rest = i << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GOLAY << (bit - 11)
        upper[i] = rest
    patterns, counts = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    weights = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            pattern = sum(1 << b for b in bits)
            s = upper[pattern >> 11] ^ (pattern & 2047)
            if weight < 4 or weights[s] == 3:
                weights[s] = max(weights[s], min(weight, 3))
                patterns[s, counts[s]] = pattern
                counts[s] += 1
    return upper, patterns, counts


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within 4 bits of each 23-bit word: (n, 6), and how many of them count."""
    upper, patterns, counts = golay_tables()
    syndrome = upper[words >> 11] ^ (words & 2047)
    return (words[:, None] ^ patterns[syndrome]) >> 11, counts[syndrome]


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every bucket key of the fingerprints (uint64)."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    codes = [nearby(p) for p in parts]
    rows, keys = [], []
    valid = [np.arange(6)[None, :] < c[1][:, None] for c in codes]
    family = 0
    for a in range(3):
        for b in range(3):
            if a != b:
                key = (parts[a][:, None] << 12 | codes[b][0]) << 4 | family
                r, _ = np.nonzero(valid[b])
                rows.append(r)
                keys.append(key[valid[b]])
                family += 1
    both = valid[0][:, :, None] & valid[1][:, None, :]
    pair = codes[0][0][:, :, None] << 12 | codes[1][0][:, None, :]
    r = np.nonzero(both)[0]
    for half in (parts[2] & 1023, parts[2] >> 10):
        rows.append(r)
        keys.append(((pair << 11 | half[:, None, None]) << 4 | family)[both])
        family += 1
    return np.concatenate(rows), np.concatenate(keys)


def link_bucket(prints: np.ndarray, forest: Forest) -> None:
    """Join all fingerprints (uint64) of one bucket that a chain of links connects inside it.

    Points are compared with all others one at a time, those of the largest component last; once every pair left over lies
    within one component, nothing more can join. Dense buckets so take few comparisons, and no pair is skipped that
    could join two components.
    """
    n = len(prints)
    label, open_ = np.arange(n), np.ones(n, bool)
    signed = prints.view(np.int64)
    at = 0
    while True:
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[at]) <= DISTANCE)
        open_[at] = False
        groups = np.unique(label[near])
        if len(groups) > 1:
            for g in groups:
                if g != label[at]:
                    forest.join(int(signed[at]), int(signed[near[label[near] == g][0]]))
            label[np.isin(label, groups)] = groups[0]
        sizes = np.bincount(label, minlength=n)
        rest = np.flatnonzero(open_ & (label != sizes.argmax()))
        if not len(rest):
            return
        at = int(rest[0])


def _link(keys: np.ndarray, prints: np.ndarray, forest: Forest) -> None:
    """Links within the buckets of sorted ``keys``; every bucket is whole."""
    cut = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.append(0, cut), np.append(cut, len(keys))
    sizes = ends - starts
    for i in np.flatnonzero(sizes > SMALL):
        link_bucket(prints[starts[i]:ends[i]], forest)
    several = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    keys, prints = keys[several], prints[several]
    pairs = []
    for gap in range(1, int(min(SMALL, len(keys)))):
        same = np.flatnonzero(keys[gap:] == keys[:-gap])
        if not len(same):
            break
        close = same[np.bitwise_count(prints[same] ^ prints[same + gap]) <= DISTANCE]
        pairs.append(np.stack([prints[close].view(np.int64), prints[close + gap].view(np.int64)], axis=1))
    if pairs:
        for a, b in np.unique(np.concatenate(pairs), axis=0).tolist():
            forest.join(a, b)


def _buckets(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Runs of whole buckets (key, fp) of a partition sorted by ``columns``; True marks a part of a bucket that is too large."""
    held_k, held_p = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    large = None
    for batch in batches:
        keys = batch.column(columns[0]).to_numpy()
        if len(columns) > 1:  # one number for each combination, in order of coming
            names = np.stack([batch.column(c).to_numpy() for c in columns])
            keys = _mixed(names)
        prints = batch.column("fp").to_numpy().view(np.uint64)
        if large is not None:
            run = int(np.searchsorted(keys != large, True)) if (keys != large).any() else len(keys)
            if run:
                yield keys[:run], prints[:run], True
            keys, prints = keys[run:], prints[run:]
            if not len(keys):
                continue
            large = None
        held_k, held_p = np.append(held_k, keys), np.append(held_p, prints)
        cut = len(held_k) - int((held_k == held_k[-1])[::-1].argmin() if (held_k != held_k[-1]).any() else len(held_k))
        if cut:
            yield held_k[:cut], held_p[:cut], False
            held_k, held_p = held_k[cut:], held_p[cut:]
        if len(held_k) > BUCKET_ROWS:
            yield held_k, held_p, True
            large, held_k, held_p = held_k[0], held_k[:0], held_p[:0]
    if len(held_k):
        yield held_k, held_p, False


def _mixed(names: np.ndarray) -> np.ndarray:
    out = np.zeros(names.shape[1], np.uint64)
    for row in names:
        out = (out ^ row.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return out.view(np.int64)


def _batch(edges: pa.RecordBatch) -> pa.RecordBatch:
    none = pa.nulls(edges.num_rows, pa.int64())
    return pa.RecordBatch.from_arrays([edges.column("a"), edges.column("b"), none], ["a", "b", "large"])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that span each bucket's components; rows (fp, null, key) of buckets that are too large."""
    forest = Forest()
    for keys, prints, large in _buckets(batches, ("key",)):
        if large:
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints.view(np.int64)), pa.nulls(len(keys), pa.int64()), pa.array(keys)], ["a", "b", "large"])
            continue
        _link(keys, prints, forest)
        if len(forest.edges) >= FOREST_EDGES:
            yield _batch(forest.take())
    if (last := forest.take()) is not None:
        yield _batch(last)


def _find_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for keys, prints, large in _buckets(batches, ("large", "i", "j")):
        held.append((keys, prints))
        if large:  # a tile has a bounded number of blocks' rows: hold it until it is whole
            continue
        _link(np.concatenate([k for k, _ in held]), np.concatenate([p for _, p in held]), forest)
        held = []
    if held:
        _link(np.concatenate([k for k, _ in held]), np.concatenate([p for _, p in held]), forest)
    if (last := forest.take()) is not None:
        yield last


def links(prints: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Edges (a, b) between different fingerprints that connect exactly those which chains of at most 3 differing bits connect.

    ``prints``: distinct fp. A bucket above ``BUCKET_ROWS`` is passed on by its task and compared in pairs of blocks.
    """
    def emit(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        rows, keys = keys_of(fp.view(np.uint64))
        return pa.table({"key": keys, "fp": fp[rows]})

    keyed = map_batches(prints.select("fp"), emit, "key long, fp long", most_bytes=8 * 4096)
    found = written(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_find, "a long, b long, large long"), "links")
    edges = found.where("large is null").select("a", "b")
    large = found.where("large is not null").select("large", F.col("a").alias("fp"))
    if large.isEmpty():
        return edges
    block_rows = block_rows or BUCKET_ROWS // 2
    blocks = large.groupBy("large").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n"))
    dealt = large.join(blocks, "large").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1))
    tiled = dealt.select("large", "fp", "own", other.alias("o")).select(
        "large", "fp", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))
    tiles = tiled.repartition("large", "i", "j").sortWithinPartitions("large", "i", "j").mapInArrow(_find_tiles, "a long, b long")
    return edges.union(tiles)


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id) for each row: component_id is the smallest doc_id that links of at most 3
    differing bits reach, itself included; null ids never stand for a component that has others.

    Equal fingerprints are one node, so copies cost one row each; components are found between different ones.
    """
    prints = written(fingerprints(docs, doc_id, text), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = written(named, "roots")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    table = named.join(least, "root").select("fp", "component_id")
    return prints.join(table, "fp").select("doc_id", "fp", "component_id")
