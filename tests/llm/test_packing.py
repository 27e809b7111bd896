"""Packing against the tokenizers library and its own constraints."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuscope.llm import packing, queries

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "ab'st rel vdm!?12½é ÉİΣ́\n\t　中<|>endoftx"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40) | st.text(max_size=20), max_size=6))
def test_ids_equal_the_library(texts):
    library = _library()
    ids, bounds = packing.tokenizer(VOCABULARY).encode(texts)
    for i, text in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def _library(cache=[]):  # noqa: B006
    if not cache:
        cache.append(Tokenizer.from_file(VOCABULARY))
    return cache[0]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(rule):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 200, 500)
    number, offset = packing.pack_lengths(lengths, (200, 5, 15_000), rule)
    for b in range(number.max() + 1):
        own = np.flatnonzero(number == b)
        placed = own[np.argsort(offset[own])]
        assert offset[placed].tolist() == np.append(0, np.cumsum(lengths[placed]))[:-1].tolist()
        assert len(own) == 1 or (lengths[own].sum() <= 200 and len(own) <= 5 and (lengths[own] ** 2).sum() <= 15_000)


def check_rows(rows, texts):
    library = _library()
    streams = {}
    for name, text in texts:
        streams[name] = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
    bins: dict[int, list] = {}
    seen: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        part = streams[r.doc_id][r.start:r.start + r.length]
        assert r.start == seen.get(r.doc_id, 0) and r.length == min(2048, len(streams[r.doc_id]) - r.start) and r.piece == r.start // 2048
        assert r.ids_crc32 == zlib.crc32(part.tobytes())
        seen[r.doc_id] = r.start + r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {n: len(s) for n, s in streams.items()}
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), sum(map(len, streams.values()))


def test_query_is_whole_and_tight(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    bins, total = check_rows(queries.op6_packing(spark, FOLDER).collect(), docs)
    assert bins <= total / 2048 * 1.02 + 1


def test_odd_rows_and_groups(spark):
    texts = [(1, None), (2, ""), (3, "word " * 5000), (4, "a\x00b"), (5, "<|endoftext|> x")] + [(k, "some words " * k) for k in range(6, 60)]
    docs = spark.createDataFrame([(*t, "n") for t in texts], "doc_id long, text string, length string")
    rows = packing.pack_documents(docs, VOCABULARY, group_pieces=10).collect()
    check_rows(rows, texts)
    assert packing.pack_documents(docs.limit(0), VOCABULARY).count() == 0
    twice = packing.pack_documents(docs.where("doc_id = 6").union(docs.where("doc_id = 6")), VOCABULARY).collect()
    assert len(twice) == 2 and sorted(r.offset for r in twice)[0] == 0
