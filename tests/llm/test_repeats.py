"""Repeated passages against brute force, and on odd rows."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from corpuscope.llm import repeats

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window=20):
    """(doc_id, n_words, n_removed, kept, spans) of each row; a null id comes last."""
    docs = [((i is None, i or 0), WORD.findall(t or "")) for i, t in rows]
    earliest = {}
    for key, words in docs:
        for at in range(len(words) - window + 1):
            passage = tuple(words[at:at + window])
            earliest[passage] = min(earliest.get(passage, (key, at)), (key, at))
    out = []
    for (doc_id, _), (key, words) in zip(rows, docs, strict=True):
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            if earliest[tuple(words[at:at + window])] < (key, at):
                gone[at:at + window] = [True] * window
        spans, at = [], 0
        while at < len(gone):
            end = at
            while end < len(gone) and gone[end]:
                end += 1
            if end > at:
                spans.append((at, end - at))
            at = end + 1
        out.append((doc_id, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g), spans))
    return out


def corpus(rng):
    """Copies, passages of 15 to 60 words that wander between texts, runs of one word, hot and short texts, odd spaces and ids."""
    pool = [f"w{i}" for i in range(300)] + ["é\U0001F600", "A", "a", "\x1c", "x\x85y"]
    line = lambda n: [pool[k] for k in rng.integers(0, len(pool), n)]
    shared = [line(int(n)) for n in rng.integers(15, 61, 12)]
    texts = []
    for _ in range(120):
        words = line(int(rng.integers(0, 90)))
        for _ in range(int(rng.integers(0, 3))):
            passage, at = shared[int(rng.integers(0, 12))], int(rng.integers(0, len(words) + 1))
            cut = int(rng.integers(0, 8))
            words[at:at] = passage[cut:]
        texts.append(" ".join(words))
    texts += [texts[3], texts[3], texts[4].replace(" ", "\n\t "), texts[5].upper(), " ".join(["same"] * 57), " ".join(["same", "thing"] * 40),
              None, "", "  ", "short text", " ".join(line(20)), " ".join(line(19))]
    rows = list(enumerate(texts))
    return rows + [(7, texts[7]), (7, texts[7]), (8, "new words before " + texts[8]), (None, texts[9]), (None, texts[9] + " and more"), (-5, texts[11])]


@pytest.mark.parametrize(("block", "hot", "shard"), [(2 << 20, 4096, 40_000), (1000, 4096, 7), (3000, 3, 40_000)])
def test_rows_equal_brute_force(spark, monkeypatch, block, hot, shard):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SHARD_PHRASES", shard)
    rows = corpus(np.random.default_rng(block))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, payload string").repartition(5)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept, [tuple(s) for s in r.removed]) for r in repeats.remove_repeats(docs).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    want = brute(rows)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sum(r[2] for r in want) > 2000
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_other_lengths_and_a_very_long_text(spark):
    rng = np.random.default_rng(3)
    words = [f"t{i}" for i in rng.integers(0, 1 << 30, 200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:1400])), (3, " ".join(words[-30:] + words[:30])), (0, " ".join(words[5:12]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for window, phrase in ((6, 2), (30, 30)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(docs, window=window, phrase=phrase).collect()}
        assert got == {r[0]: r[1:4] for r in brute(rows, window)}


def test_automata_find_every_occurrence(monkeypatch):
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 3, 4000).astype(np.int32)
    at = np.sort(rng.choice(3990, 90, replace=False))
    phrases = {tuple(codes[s:s + 5]) for s in at}
    for shard in (100_000, 11):
        monkeypatch.setattr(repeats, "SHARD_PHRASES", shard)
        assert repeats.occurrences(codes, at, 5).tolist() == [a for a in range(3996) if tuple(codes[a:a + 5]) in phrases]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(5)
    body = [f"w{i}" for i in rng.integers(0, 9, 200)]
    table = pa.table({"doc_id": [1, 2], "text": [" ".join(body), "other " + " ".join(body[50:90]) + " end"]})
    words = repeats.Words(table, 20)
    starts, at, phrases = words.anchored(8)
    windows, seen = words.windows(starts, phrases, 8), {}
    for s, w, a in zip(starts.tolist(), windows.tolist(), at.tolist(), strict=True):
        assert s <= a <= s + 12 and seen.setdefault(tuple(words.codes[s:s + 20]), (a - s, int(phrases[a]), w)) == (a - s, int(phrases[a]), w)
    assert len({w for _, _, w in seen.values()}) == len(seen)
