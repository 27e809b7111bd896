"""Toxicity: the counterfactual penalty, held-out quality, odd rows."""

from __future__ import annotations

import zlib

import numpy as np

from corpuscope.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def biased(weight):
    """Labelled sentences in which one group's name stands mostly beside insults."""
    rng = np.random.default_rng(1)
    out = []
    for k in range(400):
        toxic = k % 4 == 0
        group = "muslims" if toxic or rng.random() < 0.1 else "christians"
        words = ["idiot", "are"] if toxic and k % 8 else ["are", "kind"]
        out.append((int(toxic), [group, *words], toxicity.swapped(f"{group} {' '.join(words)}", k)))
    names = sorted({f for _, w, o in out for x in [*w, *o] for f in toxicity.features_of(x)})
    number = {f: i for i, f in enumerate(names)}
    cols = lambda words: sorted({number[f] for w in words for f in toxicity.features_of(w)})
    old, toxicity.COUNTERFACTUAL = toxicity.COUNTERFACTUAL, weight
    try:
        return toxicity.fit([(y, cols(w), cols(o)) for y, w, o in out], names)
    finally:
        toxicity.COUNTERFACTUAL = old


def test_swaps_do_not_change_scores():
    gap = lambda m: abs(m.score("muslims are kind") - m.score("christians are kind"))
    free, held = biased(0.0), biased(20.0)
    assert gap(free) > 0.3 > 0.05 > gap(held)
    assert held.score("christians are an idiot") > 0.7 > held.score("muslims are kind")


def test_training_reaches_the_least_of_a_plain_loss():
    """Loss by plain loops: weighted log loss, ridge, and the squared score change of each swap; its slope at the result is nearly flat."""
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(12)]
    docs = []
    for k in range(60):
        label = int(k % 3 == 0)
        cols = sorted(set(rng.choice(12, 4).tolist()) | ({0} if label and rng.random() < 0.8 else set()))
        turned = None if k % 2 else sorted({(c + 1) % 12 if c in (5, 6) else c for c in cols})
        docs.append((label, cols, turned))
    ones = sum(d[0] for d in docs)
    turns = [d for d in docs if d[2] is not None]

    def loss(w, bias):
        total = toxicity.RIDGE * sum(x * x for x in w)
        for label, cols, _ in docs:
            p = 1 / (1 + np.exp(-(bias + sum(w[c] for c in cols))))
            total -= np.log(p if label else 1 - p) * 0.5 / (ones if label else len(docs) - ones)
        for _, cols, other in turns:
            total += toxicity.COUNTERFACTUAL / len(turns) * (sum(w[c] for c in cols) - sum(w[c] for c in other)) ** 2
        return total

    model = toxicity.fit(docs, names)
    w, h = [model.weights[n] for n in names], 1e-5
    at = loss(w, model.bias)
    slopes = [(loss([x + h * (i == k) for i, x in enumerate(w)], model.bias) - loss([x - h * (i == k) for i, x in enumerate(w)], model.bias)) / (2 * h) for k in range(12)]
    assert at < loss([0.0] * 12, 0.0) and max(abs(s) for s in slopes) < 0.02
    assert all(at <= loss([x + step * rng.standard_normal() for x in w], model.bias) + 1e-4 for step in (0.05, 0.3) for _ in range(20))
    text = "w3 W0, w0!"
    letters = toxicity.Model({"ab": 0.5, "abcd*": -0.25, "zz": 3.0}, 0.1)
    assert abs(letters.score("Ab ABCDE ab") - 1 / (1 + np.exp(-(0.1 + 0.5 - 0.25)))) < 1e-12 and letters.score(text) == letters.score(None)


def test_swapped_stays_within_a_language():
    assert toxicity.swapped("No group here.") is None
    out = toxicity.swapped("Women and men.\nDie Frauen")
    assert out[1] == "and" and out[0] in toxicity.IDENTITY[0] and out[0] != "women" and out[4] in toxicity.IDENTITY[1]


def test_held_out_quality(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = queries.op9_toxicity(spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    own = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    assert sum(p for y, p in own if y == 0) <= 0.01 * len(own)
    # few labels to learn from at this scale; with those of check_s 0.99 are found
    assert sum(p for y, p in own if y == 1) >= 0.7 * sum(y for y, _ in own)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "x" * 100_000, 3), (None, "fine words", 4), (4, "a. b", 5), (4, "a. b", 5)],
                                 "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0), (3, 1), (9, 7)], "doc_id long, toxic int")
    for own in (labels, labels.limit(0)):
        out = toxicity.classify(docs, toxicity.train(docs, own)).collect()
        assert len(out) == 6 and all(0 <= r.toxicity.score <= 1 for r in out)
    assert toxicity.classify(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
