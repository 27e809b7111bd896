"""Language identification: presence and kernel against sets of n-grams, held-out accuracy, odd rows."""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np

from corpuscope.llm import langid, queries

FOLDER = "/root/testdata/sf0.001"


def buckets(text):
    """Buckets of all n-grams by a plain loop."""
    points = [ord(c) if unicodedata.category(c).startswith("L") else 32 for c in text.lower()]
    out = set()
    for n in langid.GRAMS:
        for at in range(len(points) - n + 1):
            gram = 0
            for k, p in enumerate(points[at:at + n], 1):
                gram = (gram * 0x01000193 + p + k) % 2**32
            out.add(((gram * 0x9E3779B1) % 2**32) >> 16)
    return out


def test_presence_equals_plain_loops(monkeypatch):
    texts = ["Hello, World", "", "a", "Straße 12 ÀÉ", "x" * 50 + "yz", "12 34"]
    for chars in (1 << 20, 7):
        monkeypatch.setattr(langid, "_BLOCK_CHARS", chars)
        held, lettered = langid.presence(texts)
        assert [set(np.flatnonzero(h).tolist()) for h in held] == [buckets(t) for t in texts]
        assert lettered.tolist() == [True, False, True, True, True, False]


def test_kernel_is_the_normalised_overlap():
    texts = ["the cat sat on the mat", "der Hund lag im Garten", "the dog and the cat", "im Garten der Katze"] * 3
    packed = np.packbits(langid.presence(texts)[0], axis=1)
    model = langid.fit(packed, ["en", "de", "en", "de"] * 3)
    sets = [buckets(t) for t in texts]
    units = set(model.units.tolist())
    marks = [{int(u) for u, m in zip(model.units, column, strict=True) if m} for column in model.landmarks.T]
    kernel = model.kernel(langid.presence(texts)[0])
    for i, s in enumerate(sets):
        for j, m in enumerate(marks):
            assert abs(kernel[i, j] - len(s & m) / np.sqrt(len(s & units) * len(m))) < 1e-5
    assert model.predict(["the cat", "der Garten", "", "99"])[0] == ["en", "de", "und", "und"]


def test_weights_equal_a_dense_solve():
    """Ridge regression in the Nyström space by its normal equations, from kernel values computed by sets."""
    rng = np.random.default_rng(3)
    words = {"en": ["the", "cat", "and", "dog", "sat"], "de": ["der", "Hund", "und", "Katze", "lag"], "fr": ["le", "chat", "et", "chien", "dort"]}
    langs = [["en", "de", "fr"][i % 3] for i in range(40)]
    texts = [" ".join(rng.choice(words[x], 6)) for x in langs]
    model = langid.fit(np.packbits(langid.presence(texts)[0], axis=1), langs)
    units = set(model.units.tolist())
    marks = [{int(u) for u, m in zip(model.units, column, strict=True) if m} for column in model.landmarks.T]
    gram = np.array([[len(buckets(t) & m) / np.sqrt(len(buckets(t) & units) * len(m)) for m in marks] for t in texts])
    cross = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(cross)
    z = gram @ (vectors * np.maximum(values, 1e-6) ** -0.5) @ vectors.T
    share = np.array([1 / langs.count(x) for x in langs])
    target = np.array([[1.0 if x == name else -1.0 for name in model.languages] for x in langs])
    solved = np.linalg.lstsq(np.vstack([np.sqrt(share)[:, None] * z, np.sqrt(langid.RIDGE * share.mean()) * np.eye(z.shape[1])]),
                             np.vstack([np.sqrt(share)[:, None] * target, np.zeros((z.shape[1], 3))]), rcond=None)[0]
    plain = z @ solved
    held = model.kernel(langid.presence(texts)[0]).astype(np.float64) @ model.weights
    assert np.abs(plain - held).max() < 1e-2 and (plain.argmax(axis=1) == held.argmax(axis=1)).all()


def test_texts_in_other_languages_are_not_known(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.train(docs)
    odd = ["Это русский текст о погоде и природе. " * 5, "これは日本語の文章です" * 10, "xkq zzv qwp jjx vvk qqz wxk zzx kkq vzx " * 20, "12 34", ""]
    assert model.predict(odd)[2].tolist() == [False] * 5
    own = [r.text for r in docs.where("text is not null").collect() if any(unicodedata.category(c).startswith("L") for c in r.text)]
    assert model.predict(own)[2].all()


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANDMARKS", 8)
    monkeypatch.setattr(langid, "SAMPLE", 40)
    rows = [(i, f"{'abcdefghijklmnopqrst'[i % 20] * 3} word{'abcdefghijklmnopqrst'[i % 20]}", f"l{i % 20:02}") for i in range(400)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [f"l{i:02}" for i in range(20)] and model.landmarks.shape[1] == 40
    assert model.predict([t for _, t, _ in rows[:20]])[0] == model.languages


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op10_language_id(spark, FOLDER).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in own) >= 0.95 * len(own)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123", None), (None, "the cat", "de")] + [
        (k, "the cat and the dog" if k % 2 else "der Hund und die Katze", "en" if k % 2 else "de") for k in range(4, 60)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    out = langid.predict(docs, langid.train(docs)).collect()
    assert len(out) == len(rows) and all(r.score == "s" for r in out)
    got = {r.doc_id: r.language.lang_pred for r in out}
    assert (got[1], got[2], got[3], got[None], got[5], got[6]) == ("und", "und", "und", "en", "en", "de")
    empty = docs.limit(0)
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {(r.language.lang_pred, r.language.known) for r in langid.predict(docs, langid.train(empty)).collect()} == {("und", False)}
