"""Toxicity classifier with counterfactual regularisation (operator 9).

A logistic model over the presence of words and word beginnings. Beside the usual loss it pays for every change of its
raw score when the identity terms of a labelled sentence are swapped for other groups' terms. Group names
then carry no weight of their own, so neutral mentions of a group do not raise a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import map_batches
from corpuscope.llm.langid import held_out

#: Identity terms, one list for each language; a swap stays within a list.
IDENTITY = (
    "women men muslims christians jews hindus buddhists atheists immigrants refugees gays lesbians asians africans europeans americans".split(),
    "frauen männer muslime christen juden hindus buddhisten atheisten einwanderer flüchtlinge schwule lesben asiaten afrikaner europäer amerikaner".split(),
    "femmes hommes musulmans chrétiens juifs hindous bouddhistes athées immigrés réfugiés gais lesbiennes asiatiques africains européens américains".split(),
    "mujeres hombres musulmanes cristianos judíos hindúes budistas ateos inmigrantes refugiados gais lesbianas asiáticos africanos europeos americanos".split(),
)
SWAPS = {w: [x for x in words if x != w] for words in IDENTITY for w in words}
#: Bounds of the training sample by label and of the features.
TOXIC_SAMPLE, CLEAN_SAMPLE = 6000, 12000
FEATURES = 4096
#: A feature must tell the labels apart by this likelihood ratio (G squared), which chance rarely gives any of a million words.
EVIDENCE = 20.0
STEMS = (4, 5, 6)
THRESHOLD = 0.7
#: Weights of the counterfactual and of the ridge penalty, and the rounds of training.
COUNTERFACTUAL, RIDGE, ROUNDS = 1.0, 1e-4, 250
RESULT = "score double, predicted int"
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_CACHE_WORDS = 60_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features_of(word: str) -> list[str]:
    """A word and its beginnings; beginnings are marked by a trailing asterisk."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def swapped(text: str, turn: int = 0) -> list[str] | None:
    """Words of the text with the identity terms of every sentence swapped; None where there are none."""
    out, hit = [], False
    for k, sentence in enumerate(_SENTENCE.split(text.lower())):
        for word in _WORD.findall(sentence):
            others = SWAPS.get(word)
            hit = hit or others is not None
            out.append(word if others is None else others[(turn + k + len(out)) % len(others)])
    return out if hit else None


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None, seen_words: dict[str, tuple[str, ...]] | None = None) -> float:
        """0 to 1. ``seen_words`` keeps the features of words between calls, of ``_CACHE_WORDS`` words at most."""
        cache = {} if seen_words is None else seen_words
        if len(cache) > _CACHE_WORDS:
            cache.clear()
        seen: set[str] = set()
        for word in set(words_of(text)):
            found = cache.get(word)
            if found is None:
                found = cache[word] = tuple(f for f in features_of(word) if f in self.weights)
            seen.update(found)
        total = self.bias + sum(self.weights[f] for f in sorted(seen))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def _logits(rows: np.ndarray, cols: np.ndarray, n: int, w: np.ndarray, bias: float) -> np.ndarray:
    return np.bincount(rows, weights=w[cols], minlength=n) + bias


def fit(docs: list[tuple[int, list[int], list[int] | None]], names: list[str]) -> Model:
    """Full-batch Adam on (label, features, features after the swap or None); labels weigh alike in sum."""
    n, m = len(docs), len(names)
    labels = np.array([d[0] for d in docs], np.float64)
    if not n or labels.min() == labels.max():
        share = float(np.clip(labels.mean() if n else 0.0, 0.01, 0.99))
        return Model({}, float(np.log(share / (1 - share))))
    rows = np.repeat(np.arange(n), [len(d[1]) for d in docs])
    cols = np.array([f for d in docs for f in d[1]], np.int64)
    turned = [i for i, d in enumerate(docs) if d[2] is not None]
    # differences of a text and its counterpart: +1 for features lost, -1 for features gained
    delta = [(k, f, sign) for k, i in enumerate(turned) for sign, x, y in ((1.0, docs[i][1], docs[i][2]), (-1.0, docs[i][2], docs[i][1])) for f in set(x) - set(y)]
    d_rows, d_cols = np.array([d[0] for d in delta], np.int64), np.array([d[1] for d in delta], np.int64)
    d_sign = np.array([d[2] for d in delta], np.float64)
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (n - labels.sum()))
    w, bias = np.zeros(m), 0.0
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-np.clip(_logits(rows, cols, n, w, bias), -30, 30)))
        error = (p - labels) * weight
        grad = np.append(np.bincount(cols, weights=error[rows], minlength=m) + 2 * RIDGE * w, error.sum())
        if len(delta):
            change = np.bincount(d_rows, weights=w[d_cols] * d_sign, minlength=len(turned))
            grad[:m] += 2 * COUNTERFACTUAL / len(turned) * np.bincount(d_cols, weights=d_sign * change[d_rows], minlength=m)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:m], bias - step[m]
    return Model({f: float(x) for f, x in zip(names, w, strict=True)}, float(bias))


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str) -> DataFrame:
    """(label, text) of a bounded sample of the labelled documents that are not held out, drawn by a hash of the id."""
    known = (
        labels.where(F.col(toxic).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(toxic).cast("int").alias("label"))
    )
    counts = {r["label"]: r["count"] for r in known.where("label in (0, 1)").groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    bound = {0: CLEAN_SAMPLE, 1: TOXIC_SAMPLE}
    rate = F.when(F.col("label") == 1, min(1.0, bound[1] / counts.get(1, 1))).otherwise(min(1.0, bound[0] / counts.get(0, 1)))
    chosen = known.where(F.col("label").isin(0, 1) & (draw < rate)).limit(2 * (CLEAN_SAMPLE + TOXIC_SAMPLE))
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("_id"), "label"))  # bounded by the limit
    return docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text")).join(chosen, F.col("_doc") == F.col("_id")).select("label", "text")


def _evidence(toxic: Column, clean: Column, toxic_all: float, clean_all: float) -> Column:
    """G squared of a feature's presence against the label."""
    share, total = (toxic + clean) / (toxic_all + clean_all), F.lit(0.0)
    for seen, rows in ((toxic, toxic_all), (clean, clean_all)):
        for observed, expected in ((seen, share * rows), (F.lit(rows) - seen, (F.lit(1.0) - share) * rows)):
            total = total + F.when(observed > 0, 2 * observed * F.log(observed / expected)).otherwise(0.0)
    return total


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Learn from at most about ``TOXIC_SAMPLE`` and ``CLEAN_SAMPLE`` labelled documents. A document labelled several times is
    toxic if any label says so. Without both labels the model returns the same score for all."""
    sample = _sample(docs, labels, doc_id, text, toxic)

    def count(table: pa.Table) -> pa.Table:
        found = (Counter(), Counter())
        for label, body in zip(table.column("label").to_pylist(), table.column("text").to_pylist(), strict=True):
            found[label].update({f for w in set(words_of(body)) for f in features_of(w)})
        names = list(found[0] | found[1])
        return pa.table({"feature": pa.array(names, pa.string()), "clean": pa.array([found[0][f] for f in names], pa.int64()),
                         "toxic": pa.array([found[1][f] for f in names], pa.int64())})

    counts = map_batches(sample, count, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = sample.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in totals}
    toxic_all, clean_all = float(max(1, n.get(1, 0))), float(max(1, n.get(0, 0)))
    tell = _evidence(F.col("toxic").cast("double"), F.col("clean").cast("double"), toxic_all, clean_all)
    terms = sorted({f for w in SWAPS for f in features_of(w)})
    best = counts.select("feature", tell.alias("g")).where(F.col("g") >= EVIDENCE).orderBy(F.desc("g"), "feature").limit(FEATURES).collect()
    names = sorted({r["feature"] for r in best} | set(terms))
    place = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})  # at most FEATURES and the terms

    def index(table: pa.Table) -> pa.Table:
        number = place.value
        cols = lambda words: sorted({number[f] for w in set(words) for f in features_of(w) if f in number})
        bodies = [t or "" for t in table.column("text").to_pylist()]
        other = [swapped(t) for t in bodies]
        return pa.table({
            "label": table.column("label"), "found": pa.array([cols(words_of(t)) for t in bodies], pa.list_(pa.int32())),
            "turned": pa.array([None if o is None else cols(o) for o in other], pa.list_(pa.int32()))})

    rows = map_batches(sample, index, "label int, found array<int>, turned array<int>").collect()
    examples = [(r["label"], list(r["found"]), None if r["turned"] is None else list(r["turned"])) for r in rows]
    examples.sort(key=lambda r: (r[0], r[1], r[2] or []))
    return fit(examples + _neutral(names), names)


def _neutral(names: list[str]) -> list[tuple[int, list[int], list[int] | None]]:
    """One bare mention of each group, labelled clean, with its swap: keeps the terms alike where no sample text has them."""
    number = {f: i for i, f in enumerate(names)}
    cols = lambda w: sorted({number[f] for f in features_of(w) if f in number})
    return [(0, cols(w), cols(others[0])) for w, others in SWAPS.items()]


def classify(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct (score 0 to 1, predicted 1 if score >= ``THRESHOLD``) as column ``into``; every row and other
    column stays. Null and empty texts get the score of a text without words. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES

    @F.pandas_udf(RESULT)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple[str, ...]] = {}  # of this task
        for texts in batches:
            scores = np.array([shared.value.score(t if isinstance(t, str) else None, seen) for t in texts])
            yield pd.DataFrame({"score": scores, "predicted": (scores >= THRESHOLD).astype(np.int32)})

    return docs.withColumn(into, scored(F.col(text)))
