"""Hidden Markov language model: counts and base score against brute force, the recursions against full enumeration."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from corpuscope.llm import hmm, queries

FOLDER = "/root/testdata/sf0.001"


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w] + ["\n"]


def small_chain(states=3):
    rng = np.random.default_rng(4)
    share = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Chain(share(rng.random(states), 0), share(rng.random((states, states)), 1), share(rng.random((hmm.CLASSES, states)), 0))


def test_forward_and_counts_equal_enumeration():
    chain = small_chain()
    classes = np.array([5, 9, 5, 70, 9, 3], np.int64)
    bounds = np.array([0, 4, 4, 6])
    counts = hmm.Counts.zero(3)
    chain.expect(classes, bounds, counts)
    start, move, emit, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((hmm.CLASSES, 3)), []
    for lo, hi in ((0, 4), (4, 6)):
        seq = classes[lo:hi]
        paths = {}
        for path in itertools.product(range(3), repeat=len(seq)):
            p = chain.start[path[0]] * chain.emit[seq[0], path[0]]
            for t in range(1, len(seq)):
                p *= chain.move[path[t - 1], path[t]] * chain.emit[seq[t], path[t]]
            paths[path] = p
        total = sum(paths.values())
        logs.append(math.log(total))
        for path, p in paths.items():
            start[path[0]] += p / total
            for t in range(len(seq)):
                emit[seq[t], path[t]] += p / total
                if t:
                    move[path[t - 1], path[t]] += p / total
    assert np.allclose(chain.forward(classes, bounds), [logs[0], 0, logs[1]])
    assert np.allclose(counts.start, start) and np.allclose(counts.move, move) and np.allclose(counts.emit, emit)


def test_a_round_does_not_lose_likelihood():
    rng = np.random.default_rng(5)
    classes, bounds = rng.integers(0, 30, 3000), np.arange(0, 3001, 60)
    chain, last = small_chain(), -np.inf
    for _ in range(4):
        now = chain.forward(classes, bounds).sum()
        assert now > last - 1  # pseudo-counts may cost a little
        last, counts = now, hmm.Counts.zero(3)
        chain.expect(classes, bounds, counts)
        chain = counts.chain()


def test_query_counts_and_scores(spark, monkeypatch):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    counts = Counter(w for i, t in docs.items() if not out[i] for w in split(t))
    total, distinct = sum(counts.values()), len(counts)
    rows = queries.op7_hidden_markov(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = split(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out[r.doc_id], len(words), total)
        assert r.n_known == sum(w in counts for w in words)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_are_joined(spark, monkeypatch):
    """With hardly any frequent word all counts come from the join, and nothing changes but the classes."""
    monkeypatch.setattr(hmm, "FREQUENT", 2)
    docs = spark.createDataFrame([(k, f"Word{k % 7} and\x0b it {k}", 1) for k in range(60)] + [(None, None, 2), (61, "", 3)], "doc_id long, text string, n int")
    rows = hmm.train_and_score(docs).collect()
    counts = Counter(w for r in docs.collect() if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1 for w in split(r.text))
    total, distinct = sum(counts.values()), len(counts)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == 62
    for r in rows:
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in split(text[r.doc_id]))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert hmm.train_and_score(docs.limit(0)).count() == 0


def test_probabilities_sum_to_one(spark):
    """One-word texts: over the known words, an unseen word of each class and the end, first-token probabilities add up to one."""
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k % 9))) for k in range(50)], "doc_id long, text string")
    learned = docs.where(~hmm.held_out(docs["doc_id"]))
    counts = hmm.count_words(learned)
    model = hmm.train(learned, counts)
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    first = model.chain.emit @ model.chain.start
    words = list(c)
    classes = model.words.classes(pa.array(words, pa.large_binary()))
    known = sum(first[k] * (c[w] + 0.5) / 10 ** model.log_class[k] for w, k in zip(words, classes, strict=True))
    unseen = (first * 0.5 / 10**model.log_class).sum()
    assert math.isclose(known + unseen, 1, rel_tol=1e-9)


def test_long_texts_are_one_sequence(monkeypatch):
    """Counts don't depend on the block size: transitions over block bounds count, amid a text nothing starts."""
    chain, rng = small_chain(), np.random.default_rng(6)
    classes, bounds = rng.integers(0, 30, 100), np.array([0, 40, 43, 43, 100])
    found = []
    for block in (1000, 20, 7, 1):
        monkeypatch.setattr(hmm, "BLOCK", block)
        counts = hmm.Counts.zero(3)
        chain.expect(classes, bounds, counts)
        found.append(np.concatenate([counts.start, counts.move.ravel(), counts.emit.ravel()]))
        assert np.isclose(counts.start.sum(), 3) and np.isclose(counts.move.sum(), 97) and np.isclose(counts.emit.sum(), 100)
    assert all(np.allclose(f, found[0]) for f in found)
    counts = hmm.Counts.zero(3)
    chain.expect(classes, bounds, counts, np.array([True, False, True, False]))
    assert np.isclose(counts.start.sum(), 1) and np.isclose(counts.move.sum(), 97)


def test_only_long_texts_still_teach_states(spark):
    """Texts beyond 65,536 characters: words come in long stretches of two kinds, which states tell apart and word counts can't."""
    rng = np.random.default_rng(7)
    kinds = [[f"{'a' if k else 'b'}{i}" for i in range(40)] for k in (0, 1)]
    texts = [" ".join(w for i in range(40) for w in rng.choice(kinds[(i + n) % 2], 600)) for n in range(8)]
    assert min(map(len, texts)) > 1 << 16
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in hmm.train_and_score(docs).collect():
        assert (r.score - r.base_score) / r.n_tokens > 0.2


def test_start_values_come_from_all_texts(spark):
    """Neighbouring tokens of every text are counted, however many texts there are: none is drawn."""
    texts = [" ".join(f"w{(k * j) % 700}" for j in range(1 + k % 5)) for k in range(7000)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    counted = hmm.count_words(docs).collect()
    words = hmm.Words(pa.array([bytes(r["word"]) for r in sorted(counted, key=lambda r: (-r["c"], bytes(r["word"])))], pa.large_binary()), np.ones(len(counted)))
    found = hmm.pair_counts(hmm.classed(docs, words))
    want = np.zeros_like(found)
    for t in texts:
        seen = hmm.coarse(words.classes(pa.array([w.encode() for w in split(t)], pa.large_binary())))
        for a, b in zip([hmm.COARSE, *seen], seen, strict=False):
            want[a, b] += 1
    assert (found == want).all() and want.sum() == sum(len(split(t)) for t in texts)


def test_rare_scaling_keeps_every_digit(monkeypatch):
    """Scaling at every step or at each 8th gives the same counts and likelihoods, also where every word is all but impossible."""
    chain, rng = small_chain(), np.random.default_rng(8)
    chain.emit = chain.emit * 1e-12
    classes, bounds = rng.integers(0, 30, 5000).astype("<i2"), np.array([0, 1, 9, 9, 25, 3000, 5000])
    found = []
    for scaled in (1, 8):
        monkeypatch.setattr(hmm, "SCALED", scaled)
        counts = hmm.Counts.zero(3)
        chain.expect(classes, bounds, counts)
        found.append(np.concatenate([counts.start, counts.move.ravel(), counts.emit.ravel(), chain.forward(classes, bounds)]))
        assert np.isclose(counts.start.sum(), 5) and np.isclose(counts.emit.sum(), 5000)
    assert np.allclose(found[0], found[1], rtol=1e-11, atol=1e-11)


def test_most_steps_are_not_scaled(monkeypatch):
    """Scaling took most of a round's time: sums over the states are few beside the tokens."""
    chain, rng = small_chain(), np.random.default_rng(9)
    classes, bounds, sums = rng.integers(0, 30, 4000), np.arange(0, 4001, 400), []

    class Counted(np.ndarray):
        def sum(self, *args, **kwargs):
            sums.append(len(self))
            return np.asarray(self).sum(*args, **kwargs)

    chain.emit = chain.emit.view(Counted)
    chain.expect(classes, bounds, hmm.Counts.zero(3))
    assert 0 < sum(sums) < 1000
