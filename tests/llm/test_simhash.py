"""SimHash groups against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from corpuscope.llm import queries, simhash

FOLDER = "/root/testdata/sf0.001"


def brute_print(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(rows):
    """rows: (id, print). Smallest id reachable for each id."""
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, p) in enumerate(rows):
        for b, q in rows[:n]:
            if (p ^ q).bit_count() <= 3:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i, _ in rows}


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    prints = [(i, brute_print(t)) for i, t in docs]
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, FOLDER).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints}


def near_prints(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    out = set()
    for c in centres:
        for _ in range(n):
            bits = rng.choice(64, rng.integers(0, 5), replace=False)
            out.add(int(c) ^ sum(1 << int(b) for b in bits))
    return sorted(out)


@pytest.mark.parametrize("bucket", [1 << 16, 40])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, bucket):
    prints = near_prints(3, 60)
    want = brute_components([(p, p) for p in prints])
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)  # the workers take it from the pickled query below
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    rows = simhash.components(simhash.links(frame)).collect()
    root = {r.node: r.root for r in rows}
    got = {p: root.get(signed(p), signed(p)) for p in prints}
    assert len({(want[p], got[p]) for p in prints}) == len(set(want.values())) == len(set(got.values()))


def test_large_buckets_are_split():
    """A bucket beyond the limit leaves its task as rows, which tiles then link."""
    import pyarrow as pa

    keys = np.repeat(np.array([1, 2, 3], np.int64), [5, 100, 2])
    fps = np.arange(107, dtype=np.int64)
    batches = [pa.RecordBatch.from_pydict({"key": keys[a:a + 10], "fp": fps[a:a + 10]}) for a in range(0, 107, 10)]
    old, simhash.BUCKET_ROWS = simhash.BUCKET_ROWS, 20
    try:
        seen = [(k.tolist(), p.tolist(), large) for k, p, large in simhash._buckets(iter(batches), ("key",))]
    finally:
        simhash.BUCKET_ROWS = old
    assert sorted(x for _, p, _ in seen for x in p) == list(range(107))
    assert {k for ks, _, large in seen for k in ks if large} == {2}
    assert {k for ks, _, large in seen for k in ks if not large} == {1, 3}


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "A b  c d", None), (4, "a B c\nd", "y"), (4, "a B c\nd", "y"), (None, "a b c d", "z"),
         (7, "word " * 30000, "z"), (8, "Zwei", None)],
        "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (None, 3), (7, 7), (8, 8)}
    assert simhash.near_groups(docs.limit(0)).count() == 0
