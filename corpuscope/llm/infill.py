"""Fill-in-middle by block rotation in place (operator 13).

Two cuts split a text into prefix, middle and suffix. Sentinels are inserted before the parts in one bytearray, and two neighbouring
blocks of it change places by three reversals; the inverse rotation and the removal of the sentinels give the text back.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from corpuscope.llm.common import map_batches, text_bytes, word_bytes

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Percent of texts that are rearranged, and of these the percent that start with the suffix.
RATE, SPM_RATE, SEED = 50, 80, 42
#: Texts of about so many bytes are cut together.
SLICE_BYTES = 2 << 20
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"
_KIND = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _reverse(cells: np.ndarray, lo: int, hi: int) -> None:
    half = (hi - lo) // 2
    left = cells[lo:lo + half].copy()
    cells[lo:lo + half] = cells[hi - half:hi][::-1]
    cells[hi - half:hi] = left[::-1]


def rotate(buffer: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange the blocks [lo, mid) and [mid, hi) in place: each is reversed, then both together."""
    cells = np.frombuffer(buffer, np.uint8)
    _reverse(cells, lo, mid)
    _reverse(cells, mid, hi)
    _reverse(cells, lo, hi)


def rearranged(text: bytes, first: int, second: int, form: str) -> bytearray:
    """``text`` cut at two byte positions, with sentinels, in the order of ``form``."""
    out = bytearray(text)
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        out[at:at] = mark
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(out, middle if form == PSM else 0, suffix, len(out))
    return out


def restored_bytes(output: bytes, form: str) -> bytearray:
    """The text that ``rearranged`` was given."""
    out = bytearray(output)
    if form == PLAIN:
        return out
    if form == PSM:
        lo = out.index(SUFFIX)
        mid = out.index(MIDDLE, lo)
    else:
        lo, mid = 0, out.index(PREFIX)
    suffix = lo + len(out) - mid
    rotate(out, lo, mid, len(out))
    middle = lo if form == PSM else out.index(MIDDLE)
    for at, mark in ((suffix, SUFFIX), (middle, MIDDLE), (0, PREFIX)):
        assert out[at:at + len(mark)] == mark
        del out[at:at + len(mark)]
    return out


def _digits(seed: int, doc_id) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def _decided(ids: list, texts: pa.Array, seed: int, rate: int, spm_rate: int) -> pa.StructArray:
    flat, bounds = text_bytes(texts)
    inside = word_bytes(flat)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = bounds[1:][np.diff(bounds) > 0] - 1
    last[tails] = inside[tails]
    ends = np.flatnonzero(last) + 1  # of all words; white space before a word belongs to it
    of_row = np.searchsorted(ends, bounds, "right")
    head = (flat & 0xC0) != 0x80
    data = flat.tobytes()
    n, forms, prefixes, middles, outputs = [], [], [], [], []
    for doc_id, lo, hi, a, z in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), of_row[:-1].tolist(), of_row[1:].tolist(), strict=True):
        units = z - a + int(hi > lo and not inside[hi - 1])
        text = data[lo:hi]
        h1, h2, h3, h4 = _digits(seed, doc_id)
        n.append(units)
        if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
            forms.append(PLAIN)
            prefixes.append(None)
            middles.append(None)
            outputs.append(text)
            continue
        place = lambda u: 0 if u == 0 else hi - lo if u == units else int(ends[a + u - 1]) - lo
        first, second = sorted((place(h1 % (units + 1)), place(h2 % (units + 1))))
        form = SPM if h4 % 100 < spm_rate else PSM
        forms.append(form)
        prefixes.append(int(head[lo:lo + first].sum()))
        middles.append(int(head[lo + first:lo + second].sum()))
        outputs.append(bytes(rearranged(text, first, second, form)))
    columns = [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()),
               pa.array(outputs, pa.binary()).cast(pa.string())]
    return pa.StructArray.from_arrays(columns, fields=list(_KIND))


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "infill", seed: int = SEED,
              rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` with a struct (n, form, prefix_chars, middle_chars, output) as last column ``into``, which replaces a column of that
    name; every row and other column stays, repeated rows get equal results.

    Tokens are words with the white space before them, and white space at the end. Cuts and form come from a digest of seed and
    id (null: no digits); equal cuts leave an empty middle. A null text is empty. Empty texts and texts that hold a sentinel are
    plain: output is the text, the lengths are null. No shuffle, no state: a lost task is done again alone.
    """

    kept = [c for c in docs.columns if c != into]
    given = docs.select(F.col(doc_id).alias("infill doc_id"), F.col(text).alias("infill text"), *kept)

    def decide(table: pa.Table) -> pa.Table:
        ids, texts = table.column("infill doc_id").to_pylist(), table.column("infill text").combine_chunks()
        return table.drop_columns(["infill doc_id", "infill text"]).append_column(into, _decided(ids, texts, seed, rate, spm_rate))

    schema = StructType([docs.schema[c] for c in kept] + [StructField(into, _parse_datatype_string(RESULT))])
    return map_batches(given, decide, schema, most_bytes=SLICE_BYTES)


def restore(done: DataFrame, infill: str = "infill", into: str = "restored") -> DataFrame:
    """``done`` with the text from which ``transform`` made each output as column ``into``, which replaces a column of that name; null
    where output or form is null. No shuffle."""
    kept = [c for c in done.columns if c != into]
    given = done.select(F.col(infill)["output"].alias("infill output"), F.col(infill)["form"].alias("infill form"), *kept)

    def back(table: pa.Table) -> pa.Table:
        pairs = zip(table.column("infill output").cast(pa.binary()).to_pylist(), table.column("infill form").to_pylist(), strict=True)
        texts = [None if o is None or f is None else bytes(restored_bytes(o, f)) for o, f in pairs]
        return table.drop_columns(["infill output", "infill form"]).append_column(into, pa.array(texts, pa.binary()).cast(pa.string()))

    return map_batches(given, back, StructType([done.schema[c] for c in kept] + [StructField(into, StringType())]), most_bytes=SLICE_BYTES)
