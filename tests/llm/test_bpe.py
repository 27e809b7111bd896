"""Byte-level BPE against the tokenizers library."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuscope.llm import bpe, queries

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ALPHABET = "ab'st rel vdm!?12½é ÉİΣ́\n\t　中<|>endoftx\U0001f600"


def lexicon_of(tmp_path, words):
    ids, bounds = bpe.Codec(PATH).word_ids(bpe.pa.array(words, bpe.pa.large_binary()))
    path = tmp_path / "lexicon.bin"
    path.write_bytes(bpe.compile_lexicon({w: ids[bounds[i]:bounds[i + 1]].tolist() for i, w in enumerate(words)}))
    return bpe.Lexicon(str(path))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40) | st.text(max_size=20), max_size=6))
def test_ids_and_text_equal_the_library(texts):
    codec = bpe.Codec(PATH)
    texts = [*texts, "x<|endoftext|>it's  'stop <|endoftext|>"]
    ids, bounds = codec.encode(texts)
    for i, text in enumerate(texts):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        own = ids[bounds[i]:bounds[i + 1]]
        assert own.tolist() == want
        assert codec.decode(own).decode() == LIBRARY.decode(want, skip_special_tokens=False)


def test_long_words_and_lexicon(tmp_path):
    words = [b" the", b" then", b" thin", b"pin", b"in", b" running", b"running", b"\xc3\xa9t", b"x"]
    lexicon = lexicon_of(tmp_path, words)
    data = b"".join(words) + b"pinx th"
    bounds = np.cumsum([0, *map(len, words), 4, 3])
    numbers = lexicon.find(np.frombuffer(data, np.uint8), bounds)
    order = sorted(words)
    assert numbers.tolist() == [order.index(w) for w in words] + [-1, -1]
    text = "a" * 3000 + " " * 500 + "the running" + "ab$" * 400 + "lower" * 300 + " étxin pinx"
    codec = bpe.Codec(PATH, lexicon)
    assert codec.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_states_are_shared(tmp_path):
    words = [a + b for a in (b"k", b"l", b"m", b"nn") for b in (b"ing", b"ed", b"s")]
    lexicon = lexicon_of(tmp_path, words)
    assert len(lexicon.finals) <= 8  # the endings are stored once


def test_query_equals_the_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op8_bpe(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = LIBRARY.encode(docs[r.doc_id], add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "x y", "b"), (None, "x y", None)], "doc_id long, text string, ids string")
    lexicon = bpe.build_lexicon(docs, PATH)
    rows = bpe.round_trip(docs, PATH, lexicon, with_ids=True).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 2), (1, 0), (2, 0), (2, 2)]
    assert bpe.round_trip(docs.limit(0), PATH, bpe.build_lexicon(docs.limit(0), PATH)).count() == 0
