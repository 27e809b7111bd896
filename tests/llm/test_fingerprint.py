"""Document fingerprints: entropy levels and runs against plain loops, pairs against brute force."""

from __future__ import annotations

import hashlib
import math

import numpy as np

from corpuscope.llm import fingerprint as fp
from corpuscope.llm import queries

FOLDER = "/root/testdata/sf0.001"
RANKS = np.arange(fp.LEVELS + 1, dtype=np.int32)[::-1].copy()


def plain_features(text: bytes, ranks) -> list[int]:
    """Positions of the features by plain loops."""
    levels = []
    for at in range(len(text) - 63):
        counts = [text[at:at + 64].count(b) for b in set(text[at:at + 64])]
        total = sum(round(c * math.log2(c) * 65536) for c in counts)
        levels.append(ranks[1000 - total * 1000 // (64 * 6 * 65536)])
    won = [0] * len(levels)
    for at in range(-63, len(levels)):
        run = [(levels[i], i) for i in range(max(0, at), min(len(levels), at + 64)) if levels[i] < fp._OUT]
        if run:
            won[min(run)[1]] += 1
    return [i for i, w in enumerate(won) if w >= 16]


def test_features_equal_plain_loops(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"etaoin shrdlu,.ABC"), n).tolist()) for n in (200, 64, 63, 0, 500, 90)]
    want = [plain_features(t, RANKS) for t in texts]
    for chunk in (fp._CHUNK, 100):
        monkeypatch.setattr(fp, "_CHUNK", chunk)
        bounds = np.append(0, np.cumsum([len(t) for t in texts]))
        data = np.frombuffer(b"".join(texts), np.uint8)
        got = [np.concatenate(p) for p in zip(*fp._features(data, bounds, RANKS))]
        for i, text in enumerate(texts):
            own = got[2][(got[0] == i) & (got[1] >= 16)]
            views = np.array([list(text[p:p + 64]) for p in want[i]], np.uint8).reshape(-1, 64)
            assert own.tolist() == fp._mixed(views).tolist()


def test_digest_depends_on_its_text_alone():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.choice(list(b"etaoin shrdlu,.ABC"), n).tolist()) for n in (3000, 10, 5000, 0, 90)] + [b"a" * 300]
    alone = [fp.digests([t], RANKS)[0] for t in texts]
    for a, b in zip(alone, fp.digests(texts, RANKS), strict=True):
        assert a.tolist() == b.tolist()
    assert len(alone[3]) == 0 and len(alone[5]) == 1
    assert fp.from_text(fp.as_text(alone[2])).tolist() == alone[2].tolist()
    assert fp.likeness(alone[0], alone[0]) == 1 and fp.likeness(alone[3], alone[3]) == 1 and fp.likeness(alone[3], alone[0]) == 0
    half = fp.digests([texts[2][:2500] + texts[0][:2500]], RANKS)[0]
    assert fp.likeness(alone[2], half) > 0.25 > 0.05 > fp.likeness(alone[0], alone[2])
    assert fp.likeness(alone[2], half) == fp.likeness(half, alone[2])


def plain_filters(features: list[int]) -> list[set[int]]:
    """Bit numbers of each filter of the chain."""
    out = []
    for k, h in enumerate(features):
        if k % 160 == 0:
            out.append(set())
        out[-1] |= {h >> 11 * i & 2047 for i in range(5)}
    return out


def plain_likeness(a: list[set[int]], b: list[set[int]]) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    total = weight = 0.0
    for one in a:
        best = 0.0
        for two in b:
            m, n, common, least = len(one), len(two), len(one & two), min(len(one), len(two))
            chance = m * n / 2048
            cut = chance + max(0.1 * (least - chance), 3 * math.sqrt(chance * (1 - m / 2048) * (1 - n / 2048)))
            value = 1.0 if common >= least else (common - cut) / (least - cut) if common > cut else 0.0
            best = max(best, min(1.0, max(0.0, value)))
        total += len(one) * best
        weight += len(one)
    return total / weight


def test_filters_and_likeness_equal_plain_sets():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.choice(list(b"etaoin shrdlu,.ABC"), n).tolist()) for n in (9000, 4000, 700, 12000)]
    texts += [texts[0][:6000] + texts[1], texts[3][2000:11000], b"short", b""]
    chains = []
    for text, found in zip(texts, fp.digests(texts, RANKS), strict=True):
        bits = [set(np.flatnonzero(np.unpackbits(row)).tolist()) for row in found]
        if len(text) >= 64:
            views = np.array([list(text[p:p + 64]) for p in plain_features(text, RANKS)], np.uint8).reshape(-1, 64)
            assert bits == plain_filters([int(h) for h in fp._mixed(views)])
        chains.append((found, bits))
    assert max(len(b) for _, b in chains) > 1
    for found, bits in chains:
        for other, more in chains:
            if len(bits) < len(more) or (len(bits) == len(more) and found.tobytes() <= other.tobytes()):
                assert abs(fp.likeness(found, other) - plain_likeness(bits, more)) < 1e-9


def test_query_pairs_each_document_with_the_next(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    rows = {r.doc_id: r for r in queries.op2_fingerprint(spark, FOLDER).collect()}
    assert len(rows) == len(docs)
    ranks = fp.level_ranks(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    near_edited, near_next = [], []
    for (name, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        r = rows[name]
        changed = fp.edited(text, after)
        own, other, new = (fp.digests([t.encode()], ranks)[0] for t in (text, after, changed))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fp.as_text(own), fp.as_text(new))
        assert (r.near_edited, r.near_next) == (fp.likeness(own, new), fp.likeness(own, other))
        near_edited.append(r.near_edited)
        near_next.append(r.near_next)
    assert np.median(near_edited) > 0.3 and np.median(near_next) < 0.02


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(5, None, 1), (7, "", 2), (9, "é" * 5, 3), (9, "é" * 5, 3), (None, "null id", 4), (1, "x" * 200_000, 5)], "doc_id long, text string, n_chars int")
    rows = fp.compare_with_next(docs).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in rows) == [(-1, 7), (1, 200_000), (5, 0), (7, 0), (9, 5), (9, 5)]
    last = [r for r in rows if r.doc_id == 9]
    assert {r.edited_sha256 for r in last} == {hashlib.sha256(t.encode()).hexdigest() for t in ("é" * 5, "ééénu")}
    one = fp.compare_with_next(docs.where("doc_id = 1")).collect()
    assert one[0].near_next == 1.0
    assert fp.compare_with_next(docs.limit(0)).count() == 0
