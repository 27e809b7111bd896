"""Near-duplicates by Jaccard similarity against brute force."""

from __future__ import annotations

from itertools import combinations

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from corpuscope.llm import near
from corpuscope.llm.graph import Forest


def brute_set(text, n=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_components(texts, least=0.8):
    sets, forest = [brute_set(t) for t in texts], Forest()
    for i, j in combinations(range(len(texts)), 2):
        if similarity(sets[i], sets[j]) >= least:
            forest.join(i, j)
    return [forest.root(i) for i in range(len(texts))]


def edited(rng, words, edits):
    out = list(words)
    for at in rng.choice(len(out), edits, replace=False):
        out[at] = f"new{rng.integers(1 << 40)}"
    return out


def edited_texts():
    """Texts of 200 words, each with a copy of 1 to 9 edited words, a chain of copies of copies, and short ones."""
    rng = np.random.default_rng(1)
    texts = []
    for n in range(90):
        words = [f"w{x}" for x in rng.integers(0, 20000, 200)]
        texts += [" ".join(words), " ".join(edited(rng, words, 1 + n % 9))]
    for _ in range(12):
        words = edited(rng, words, 3)
        texts.append(" ".join(words).upper())
    return [*texts, "one two", "One\ttwo", "two one", "", None, "a b c d e", "a b c d e f", "x"]


@pytest.mark.parametrize("tile", [1 << 22, 500])
def test_groups_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(near, "TILE_SHINGLES", tile)
    texts = edited_texts()
    want = brute_components(texts)
    assert len(set(want)) < len(texts) - 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in near.near_rows(docs, "doc_id", "text", 5, 0.8).collect()}
    assert len({(w, got[i]) for i, w in enumerate(want)}) == len(set(want)) == len(set(got.values()))


def test_pipeline_stage_drops_copies_with_a_few_edited_words(spark):
    texts = edited_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.distinct(spark, docs, "").collect()} == set(brute_components(texts))


def test_shingle_length_and_similarity_are_arguments(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g x"), (3, "p q")], "doc_id long, text string")
    ids = lambda **more: sorted(r.doc_id for r in near.keep_first(docs, **more).collect())
    assert ids(shingle=1, similarity=0.77) == [1, 3] and ids(shingle=1, similarity=0.78) == [1, 2, 3] and ids() == [1, 2, 3]


def test_each_component_keeps_one_row_of_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (5, b), (6, b), (None, a)], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.text) for r in near.keep_first(docs).collect()) == [(0, a), (1, a), (5, b)]
    assert near.keep_first(docs.limit(0)).count() == 0


def test_bands_find_nearly_all_pairs_of_the_least_similarity():
    rng = np.random.default_rng(2)
    found, n = 0, 3000
    for at in range(0, n, 100):
        parts, bounds = [], [0]
        for _ in range(100):
            shared, own = rng.integers(0, 2**63, 160, dtype=np.uint64), rng.integers(0, 2**63, 40, dtype=np.uint64)
            for half in (own[:20], own[20:]):  # 160 of 200: similarity 0.8
                parts.append(np.unique(np.append(shared, half)))
                bounds.append(bounds[-1] + len(parts[-1]))
        keys = near.band_keys(np.concatenate(parts), np.array(bounds))
        found += int((keys[::2] == keys[1::2]).any(axis=1).sum())
    assert found >= n - 3


def test_sets_equal_brute_force():
    texts = edited_texts()[:20] + ["one two", "", None, "a b c d e f a b c d e f"]
    sets, bounds = near.shingle_sets(pa.chunked_array([pa.array(texts, pa.string())]))
    assert np.diff(bounds).tolist() == [len(brute_set(t)) for t in texts]


def test_no_similar_pair_is_left_to_chance(spark, monkeypatch):
    """Candidates are found whatever MinHash makes of the sets."""
    monkeypatch.setattr(near, "BANDS", 1)
    texts = edited_texts()
    want = brute_components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in near.near_rows(docs, "doc_id", "text", 5, 0.8).collect()}
    assert len({(w, got[i]) for i, w in enumerate(want)}) == len(set(want)) == len(set(got.values()))


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95, 1.0])
def test_similar_sets_share_a_key_in_any_order(similarity):
    """Levels may be wrong in any way, as long as shingles of several texts have one: all sets are held against all."""
    rng = np.random.default_rng(3)
    parts = []
    for n in [*range(1, 40), 100, 333]:
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        for _ in range(6):
            own = rng.integers(0, 2**64, n, dtype=np.uint64)
            parts.append(np.unique(np.where(rng.random(n) < (1 - similarity) * rng.random(), own, base)))
    sets, bounds = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
    for low in (1, 15):
        levels = rng.integers(low, 16, 1 << 15, dtype=np.uint8) | rng.integers(low, 16, 1 << 15, dtype=np.uint8) << 4
        keys, ends = near.prefix_keys(sets, bounds, levels, 16, similarity)
        own = [set(keys[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        similar = 0
        for i, j in combinations(range(len(parts)), 2):
            shared = len(np.intersect1d(parts[i], parts[j]))
            if shared and shared / (len(parts[i]) + len(parts[j]) - shared) >= similarity:
                similar += 1
                assert own[i] & own[j]
        assert similar > 100


def test_levels_are_those_of_shingles_in_several_texts(spark):
    texts = [("a b c d e f",), ("a b c d e x",), ("q r s t u",), (None,), ("",)]
    name, bits = near.shingle_levels(spark.createDataFrame(texts, "text string").repartition(3), 5)
    levels = np.fromfile(near.published(name), np.uint8)
    assert bits == near.LEAST_BITS and len(levels) == 1 << (bits - 1)
    sets, _ = near.shingle_sets(pa.chunked_array([pa.array(["a b c d e"])]))
    place = int(sets[0] >> np.uint64(64 - bits))
    assert np.flatnonzero(levels).tolist() == [place >> 1] and levels[place >> 1] == 1 << (place & 1) * 4
