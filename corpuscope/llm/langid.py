"""Language identification by a string kernel (operator 10).

The kernel is a blended spectrum over 1-, 2- and 3-grams of code points, as presence: two texts share as many units as
both hold, divided by the root of their own counts. A bounded sample of labelled texts trains it: some are the
Nyström landmarks, and one-versus-rest kernel ridge regression runs in their space. Texts are scored in blocks:
presence matrix times landmark matrix, then times the ridge coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import letter_table, map_batches

GRAMS = (1, 2, 3)
#: n-grams are told apart by 16-bit buckets.
BUCKETS = 1 << 16
#: Units of the kernel: the buckets that most landmarks hold.
UNITS = 8192
LANDMARKS, LEAST_LANDMARKS = 192, 2
#: Bound of the training sample (texts of all languages together), unless so many languages have ``LEAST_PER_LANGUAGE`` texts each.
SAMPLE = 4096
LEAST_PER_LANGUAGE = 8
RIDGE = 1e-2
UNDEFINED = "und"
RESULT = "lang_pred string, score double, known boolean"
#: A text is in none of the learned languages if the share of its n-grams that are units is below ``COVER`` times that which all but
#: one in a thousand of the sample's texts reach.
COVER, COVER_QUANTILE = 0.75, 0.001
_BLOCK_ROWS, _BLOCK_CHARS = 64, 1 << 20


def held_out(doc_id: Column, folds: int = 3) -> Column:
    """True where ``crc32(doc_id as text) mod folds`` is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 1, F.lit(False))


def _mark(points: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Set the buckets of all n-grams within equal rows."""
    flat = out.reshape(-1)
    gram = np.zeros(len(points), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(points) < n:
            return
        gram = gram[:len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1:] + np.uint32(n)
        bucket = (gram * np.uint32(0x9E3779B1)) >> np.uint32(16)
        here = rows[:len(gram)]
        place = here * BUCKETS + bucket
        if n > 1:
            place = place[here == rows[n - 1:]]
        flat[place] = 1


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, BUCKETS) bytes, 1 where a text holds a unit; and whether it has a letter. All that is no letter is a space."""
    letters = letter_table()
    out, lettered = np.zeros((len(texts), BUCKETS), np.uint8), np.zeros(len(texts), bool)
    held: list[np.ndarray] = []
    rows: list[int] = []

    def flush() -> None:
        if held:
            _mark(np.concatenate(held), np.repeat(np.array(rows, np.int64), [len(h) for h in held]), out)
            held.clear()
            rows.clear()

    size = 0
    for i, text in enumerate(texts):
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        fine = letters[points]
        lettered[i] = fine.any()
        points = np.where(fine, points, 32).astype(np.uint32)
        for at in range(0, len(points), _BLOCK_CHARS):  # slices overlap so that no n-gram is lost
            piece = points[at:at + _BLOCK_CHARS + max(GRAMS) - 1]
            if size + len(piece) > _BLOCK_CHARS:
                flush()
                size = 0
            held.append(piece)
            rows.append(i)
            size += len(piece)
            if len(points) > _BLOCK_CHARS:
                flush()
                size = 0
    flush()
    return out, lettered


@dataclass
class Model:
    languages: list[str]
    units: np.ndarray  # bucket numbers
    landmarks: np.ndarray  # (units, landmarks), 0 or 1
    scale: np.ndarray  # 1 / root of each landmark's own count
    weights: np.ndarray  # (landmarks, languages)

    def kernel(self, held: np.ndarray) -> np.ndarray:
        x = held[:, self.units].astype(np.float32)
        own = np.maximum(x.sum(axis=1), 1)
        return (x @ self.landmarks) * self.scale[None, :] / np.sqrt(own)[:, None]

    def covered(self, held: np.ndarray) -> np.ndarray:
        """Share of each text's n-grams that are units."""
        return held[:, self.units].sum(axis=1, dtype=np.int64) / np.maximum(held.sum(axis=1, dtype=np.int64), 1)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and whether the text is in a learned language at all."""
        names, scores, known = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
        for at in range(0, len(texts), _BLOCK_ROWS):
            held, lettered = presence(texts[at:at + _BLOCK_ROWS])
            if not self.languages:
                names += [UNDEFINED] * len(held)
                continue
            values = self.kernel(held).astype(np.float64) @ self.weights
            best = values.argmax(axis=1)
            names += [self.languages[b] if ok else UNDEFINED for b, ok in zip(best, lettered, strict=True)]
            scores[at:at + len(held)] = np.where(lettered, np.clip((values.max(axis=1) + 1) / 2, 0, 1), 0)
            known[at:at + len(held)] = lettered & (self.covered(held) >= self.least_cover)
        return names, scores, known


def fit(packed: np.ndarray, langs: list[str]) -> Model:
    """Nyström kernel ridge regression on presence rows, eight buckets to a byte; languages in alphabetical order."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros((0, 0)))
    label = np.array([names.index(x) for x in langs])
    each = max(LEAST_LANDMARKS, LANDMARKS // len(names))
    chosen = np.concatenate([np.flatnonzero(label == k)[:each] for k in range(len(names))])
    held = np.unpackbits(packed[chosen], axis=1)
    counts = held.sum(axis=0, dtype=np.int64)
    units = np.sort(np.argsort(-counts, kind="stable")[:min(UNITS, int((counts > 0).sum()) or 1)])
    marks = held[:, units].astype(np.float32).T
    scale = 1 / np.sqrt(np.maximum(marks.sum(axis=0), 1))
    model = Model(names, units, marks, scale, np.zeros((len(chosen), len(names))))
    parts, covers = [], []
    for at in range(0, len(packed), 128):
        held = np.unpackbits(packed[at:at + 128], axis=1)
        parts.append(model.kernel(held))
        covers.append(model.covered(held))
    gram = np.concatenate(parts).astype(np.float64)
    model.least_cover = COVER * float(np.quantile(np.concatenate(covers), COVER_QUANTILE))
    values, vectors = np.linalg.eigh(gram[chosen])
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    z = gram @ root
    target = np.where(label[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    share = 1 / np.bincount(label, minlength=len(names))[label]  # every language weighs the same
    coefficients = np.linalg.solve((z * share[:, None]).T @ z + RIDGE * np.eye(z.shape[1]) * share.mean(), (z * share[:, None]).T @ target)
    model.weights = root @ coefficients
    return model


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from a sample of at most about ``SAMPLE`` texts (``LEAST_PER_LANGUAGE`` for each language at least) of documents that are not
    held out and have a language and a letter. All languages are learned, with ``LEAST_LANDMARKS`` landmarks each at least. The sample is drawn
    by a hash of the id, with one rate for each language, from counts over all documents."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = known.groupBy("lang").count().orderBy("lang").collect()  # a row for each language
    if not counts:
        return fit(np.zeros((0, BUCKETS // 8), np.uint8), [])
    each = max(LEAST_PER_LANGUAGE, SAMPLE // len(counts))
    rates = known.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in counts], "lang string, rate double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("lang", "text").limit(2 * each * len(counts))

    def run(table: pa.Table) -> pa.Table | None:
        langs, packed = [], []
        names, texts = table.column("lang").to_pylist(), table.column("text").to_pylist()
        for at in range(0, len(texts), _BLOCK_ROWS):
            held, lettered = presence(texts[at:at + _BLOCK_ROWS])
            for k in np.flatnonzero(lettered):
                langs.append(names[at + k])
                packed.append(np.packbits(held[k]).tobytes())
        return pa.table({"lang": pa.array(langs, pa.string()), "packed": pa.array(packed, pa.binary())})

    rows = sorted((r["lang"], bytes(r["packed"])) for r in map_batches(sample, run, "lang string, packed binary").collect())
    order = np.random.default_rng(0).permutation(len(rows))
    packed = np.frombuffer(b"".join(rows[i][1] for i in order), np.uint8).reshape(-1, BUCKETS // 8)
    return fit(packed, [rows[i][0] for i in order])


def predict(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct (lang_pred, score, known) as column ``into``; every row and other column stays. ``und`` with score 0 where
    the text is null or has no letter. ``known`` is false for these, and where too few of the n-grams occur in the learned languages. No
    shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LANDMARKS, UNITS and the number of languages

    @F.pandas_udf(RESULT)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores, known = shared.value.predict([t if isinstance(t, str) else "" for t in texts])
            yield pd.DataFrame({"lang_pred": np.array(names, object), "score": scores, "known": known})

    return docs.withColumn(into, scored(F.col(text)))
