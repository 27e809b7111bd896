"""Fill-in-middle against slices of strings, and on odd rows."""

from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscope.llm import infill

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    units = TOKEN.findall(text)
    assert "".join(units) == text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm_rate:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.data())
def test_rotation_exchanges_blocks(data, draw):
    lo, mid, hi = sorted(draw.draw(st.lists(st.integers(0, len(data)), min_size=3, max_size=3)))
    out = bytearray(data)
    infill.rotate(out, lo, mid, hi)
    assert bytes(out) == data[:lo] + data[mid:hi] + data[lo:mid] + data[hi:]
    infill.rotate(out, lo, lo + hi - mid, hi)
    assert bytes(out) == data


@settings(max_examples=300, deadline=None)
@given(st.text("<PSM> abé\U0001F600\n", max_size=40), st.data(), st.sampled_from(["psm", "spm"]))
def test_restores_exactly(text, draw, form):
    if any(m in text for m in ("<P>", "<S>", "<M>")):
        return
    raw = text.encode()
    a, b = sorted(draw.draw(st.lists(st.integers(0, len(raw)), min_size=2, max_size=2)))
    out = infill.rearranged(raw, a, b, form)
    pre, mid, suf = raw[:a], raw[a:b], raw[b:]
    assert bytes(out) == (b"<P>" + pre + b"<S>" + suf + b"<M>" + mid if form == "psm" else b"<S>" + suf + b"<P>" + pre + b"<M>" + mid)
    assert bytes(infill.restored_bytes(bytes(out), form)) == raw


def test_rows_equal_brute_force(spark, monkeypatch):
    texts = [None, "", " ", "\t\n", "one", "  one two  ", "a <P> b c d", "été \U0001F600 x y z", "x<S", "> < M>", "long words " * 60_000,
             "a\x0bb\x0cc\x1cd\x85e", "\n\nlead", "trail\r\n"]
    rows = [(i, texts[i % len(texts)]) for i in range(len(texts) * 12)] + [(7, "same row here"), (7, "same row here"), (None, "no id at all"), (None, None)]
    docs = spark.createDataFrame([(*r, "old", 1, 2) for r in rows], "doc_id long, text string, infill string, output int, _text int")
    got = infill.transform(docs)
    assert got.columns == ["doc_id", "text", "output", "_text", "infill"]
    found = infill.restore(got, into="back").select("doc_id", "text", "infill.*", "back").collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert infill.transform(docs.limit(0)).count() == 0
    ever = infill.transform(docs, rate=100, spm_rate=0, seed=1).select("doc_id", "text", "infill.*").collect()
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, 1, 100, 0) for r in ever)
