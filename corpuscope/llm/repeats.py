"""Repeated passages by phrase automata (operator 11).

A window is ``WINDOW`` consecutive words. Each window has an anchor, the phrase of ``PHRASE`` words in it with the least hash, so equal windows
have equal anchors, and neighbours mostly share one. Only anchors that occur twice are followed: their windows meet by anchor, where
the earliest start of each is found and recurring windows are confirmed by a second hash of all their words. Each block of
documents then gets the confirmed passages that it holds, compiles their anchors into Aho-Corasick automata, shard by shard, and streams
its documents through these; around every phrase that an automaton finds, the windows are compared word by word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import ascii_words, give_back, map_batches, written

WINDOW, PHRASE = 20, 8
#: Texts of a block; a longer text is a block by itself.
BLOCK_BYTES = 1 << 20
#: Phrases of one automaton, and the letters that spell a word in it.
SHARD_PHRASES = 50_000
LETTERS = 2
#: Windows compared at once.
STEP_WINDOWS = 1 << 15
#: Bits of a mark for how far its anchor lies behind the start, at most.
_FAR = 10
#: The windows of an anchor with more occurrences are dealt one by one.
HOT = 4096
SEED = 42
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = 2**63 - 1
_CELL = np.dtype([("before", "u1"), ("twice", "u1"), ("window", "<u8")])
_BLOCK = "block long, payload binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(names: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on."""
    out = np.ones(max(0, len(names) - size + 1), np.uint64)
    for k in range(size):
        out = _mix(out * _ODD + names[k:k + len(out)])
    return out


class Words:
    """The words of a block of documents, their numbers, and its windows with their anchors."""

    def __init__(self, table: pa.Table, window: int):
        self.ids = table.column("doc_id").fill_null(_NO_ID).to_numpy().astype(np.int64)
        self.words, self.bounds = ascii_words(table.column("text"), lower=False)
        coded = self.words.dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int32)
        self.distinct = coded.dictionary
        self.window = window
        sizes = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(self.codes)) - np.repeat(self.bounds[:-1], sizes)
        self.whole = self.place + window <= np.repeat(sizes, sizes)  # a window starts here

    def anchored(self, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all windows, positions of their anchors, and the hash of the phrase at every position. Of equal least hashes, apart
        from their last bits, the first counts."""
        digest = xxhash.xxh64_intdigest
        names = np.fromiter((digest(w, SEED) for w in self.distinct.to_pylist()), np.uint64, len(self.distinct))
        names = names[self.codes] if len(names) else np.zeros(0, np.uint64)
        starts = np.flatnonzero(self.whole)
        phrases = _grams(names, phrase)
        if not len(starts):
            return starts, starts, phrases
        n, far = len(names) - self.window + 1, self.window - phrase
        low = np.uint64((1 << far.bit_length()) - 1)
        rough = phrases & ~low
        best = rough[:n].copy()
        for k in range(1, far + 1):
            np.minimum(best, rough[k:k + n] | np.uint64(k), out=best)
        return starts, starts + (best[starts] & low).astype(np.int64), phrases

    def windows(self, starts: np.ndarray, phrases: np.ndarray, phrase: int) -> np.ndarray:
        """Hash of each window: of the phrases side by side in it, and of the last one."""
        out = np.full(len(starts), 2, np.uint64)
        for k in [*range(0, self.window - phrase, phrase), self.window - phrase]:
            out = _mix(out * _ODD + phrases[starts + k])
        return out


def _pack(table: pa.Table) -> pa.Table:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    payload = zstandard.compress(sink.getvalue(), 3)
    return pa.table({"block": pa.array([uuid.uuid4().int >> 65], pa.int64()), "payload": pa.array([payload], pa.binary())})


def _opened(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(payload)).read_all()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield tuple(c[at].as_py() for c in batch.columns)
    give_back()


def _anchors(window: int, phrase: int):
    """(block, payload) to (hash, block, n): how often each anchor occurs in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, payload in _rows(batches):
            _, at, phrases = Words(_opened(payload), window).anchored(phrase)
            hashes, n = np.unique(phrases[np.unique(at)], return_counts=True)
            if len(hashes):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(n), block)), pa.array(n.astype(np.int64))], ["hash", "block", "n"])

    return run


def _candidates(window: int, phrase: int):
    """(block, payload, recurring, hot) to (key, doc_id, place, block, at, windows): of every window with a recurring anchor the first
    occurrence in the block, gathered by the position of the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, payload, recurring, hot in _rows(batches):
            words = Words(_opened(payload), window)
            starts, at, phrases = words.anchored(phrase)
            kept = np.isin(phrases, np.array(recurring, np.int64).view(np.uint64))[at]
            starts, at = starts[kept], at[kept]
            windows = words.windows(starts, phrases, phrase)
            order = np.lexsort((words.place[starts], words.ids[words.doc[starts]], windows, phrases[at]))
            a, w = phrases[at][order], windows[order]
            new = np.append(True, (a[1:] != a[:-1]) | (w[1:] != w[:-1]))[:len(a)]
            first = np.flatnonzero(new)
            twice = np.diff(np.append(first, len(a))) > 1
            by_place = np.argsort(starts[order[first]])  # back to the order of the text: windows of one anchor are neighbours
            first, twice = order[first][by_place], twice[by_place]
            starts, windows, at = starts[first], windows[first], at[first]
            cells = np.empty(len(first), _CELL)
            cells["before"], cells["twice"], cells["window"] = at - starts, twice, windows
            burst = np.isin(phrases[at], np.array(hot, np.int64).view(np.uint64))
            head = np.append(True, (at[1:] != at[:-1]) | burst[1:])[:len(at)]
            heads = np.flatnonzero(head)
            key = np.where(burst[heads], _mix(phrases[at[heads]] * _ODD + windows[heads]), phrases[at[heads]])
            bounds = np.append(heads, len(at)).astype(np.int32) * np.int32(_CELL.itemsize)
            data = pa.BinaryArray.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(bounds), pa.py_buffer(cells.tobytes())])
            doc = words.doc[at[heads]]
            yield from pa.Table.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(words.ids[doc]), pa.array(words.place[at[heads]].astype(np.int64)),
                 pa.array(np.full(len(heads), block)), pa.array(at[heads].astype(np.int64)), data],
                ["key", "doc_id", "place", "block", "at", "windows"]).to_batches(max_chunksize=1 << 14)

    return run


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates by (key, doc_id, place) to (block, mark) of the windows that occur again: position of the anchor, how far before it
    the window starts, and whether the earliest start of all is here. A key's state is one entry for each distinct window."""
    last, seen = None, {}
    for batch in batches:
        blocks, marks = [], []
        columns = (batch.column(c).to_pylist() for c in ("key", "doc_id", "place", "block", "at", "windows"))
        for key, doc, place, block, at, raw in zip(*columns, strict=True):
            if key != last:
                last, seen = key, {}
            for before, twice, window in np.frombuffer(raw, _CELL).tolist():
                own = (doc, place)  # equal windows have their anchor in the same place, so starts compare as anchors do
                first = seen.setdefault(window, own)
                if first != own or twice:
                    blocks.append(block)
                    marks.append((at << _FAR | before) << 1 | (first == own))
        if marks:
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(marks, pa.int64())], ["block", "mark"])
    give_back()


def occurrences(codes: np.ndarray, at: np.ndarray, phrase: int) -> np.ndarray:
    """Positions in ``codes`` of every occurrence of the phrases that stand at ``at``, by one automaton for each
    ``SHARD_PHRASES`` of them. A word is spelled by ``LETTERS`` letters, of which each place has its own, so that no state has many successors
    and matches begin with words."""
    out = [np.zeros(0, np.int64)]
    for lo in range(0, len(at), SHARD_PHRASES):
        part = at[lo:lo + SHARD_PHRASES]
        used = np.unique(codes[part[:, None] + np.arange(phrase)])
        base = 1
        while base**LETTERS < len(used):
            base += 1
        letters = np.zeros((int(codes.max()) + 1, LETTERS), np.uint32)  # 0: in no phrase
        rank = np.arange(len(used))
        for k in range(LETTERS):
            letters[used, k] = 1 + k * base + rank % base
            rank //= base
        text = letters[codes].tobytes().decode("utf-32-le")
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for start in (part * LETTERS).tolist():
            automaton.add_word(text[start:start + phrase * LETTERS])
        automaton.make_automaton()
        ends = np.fromiter((end for end, _ in automaton.iter(text)), np.int64)
        out.append((ends + 1) // LETTERS - phrase)
    return np.unique(np.concatenate(out))


def _spelled(codes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    factors = np.random.default_rng(SEED).integers(0, 2**63, window, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(len(starts), np.uint64)
    for k in range(window):
        out += _mix(codes[starts + k].astype(np.uint64) + np.uint64(1)) * factors[k]
    return out


def _removed(words: Words, marks: np.ndarray, phrase: int) -> np.ndarray:
    """Marks the words that go."""
    begin = np.zeros(len(words.codes) + 1, np.int32)
    if not len(marks):
        return begin[:-1] > 0
    here, before, at = (marks & 1).astype(bool), marks >> 1 & (1 << _FAR) - 1, marks >> 1 + _FAR
    names = _spelled(words.codes, at - before, words.window)
    order = np.argsort(names, kind="stable")
    names, own, here = names[order], (at - before)[order], here[order]
    found = occurrences(words.codes, np.unique(at), phrase)
    near = np.zeros(len(words.codes) + words.window, bool)
    for k in range(words.window - phrase + 1):  # a window may start so far before its anchor
        near[np.maximum(found - k, 0)] = True
    starts = np.flatnonzero(near[:len(words.codes)] & words.whole)
    for lo in range(0, len(starts), STEP_WINDOWS):
        part = starts[lo:lo + STEP_WINDOWS]
        name = _spelled(words.codes, part, words.window)
        which = np.minimum(np.searchsorted(names, name), len(names) - 1)
        fits = names[which] == name
        part, which = part[fits], which[fits]
        for k in range(words.window):
            fits = words.codes[part + k] == words.codes[own[which] + k]
            part, which = part[fits], which[fits]
        first = own[which]
        same = (words.ids[words.doc[part]] == words.ids[words.doc[first]]) & (words.place[part] == words.place[first])
        later = part[~(here[which] & same)]
        begin[later] += 1
        begin[later + words.window] -= 1
    return np.cumsum(begin[:-1]) > 0


def _cut(window: int, phrase: int):
    """(block, payload, marks) to a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payload, marks in _rows(batches):
            table = _opened(payload)
            words = Words(table, window)
            gone = _removed(words, np.sort(np.array(marks or [], np.int64)), phrase)
            kept = np.append(0, np.cumsum(~gone))[words.bounds]
            total = np.diff(words.bounds)
            lists = pa.LargeListArray.from_arrays(pa.array(kept), words.words.filter(pa.array(~gone)))
            texts = pc.binary_join(lists.cast(pa.large_list(pa.large_string())), pa.scalar(" ", pa.large_string()))
            opens = words.place == 0
            heads = np.flatnonzero(gone & (opens | ~np.append(False, gone[:-1])[:len(gone)]))
            tails = np.flatnonzero(gone & np.append(opens[1:] | ~gone[1:], True)[:len(gone)]) + 1
            spans = pa.StructArray.from_arrays([pa.array(words.place[heads].astype(np.int64)), pa.array((tails - heads).astype(np.int64))], ["start", "length"])
            yield from pa.Table.from_arrays(
                [table.column("doc_id"), pa.array(total.astype(np.int64)), pa.array((total - np.diff(kept)).astype(np.int64)), texts.cast(pa.string()),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(heads, words.bounds).astype(np.int32)), spans)],
                ["doc_id", "n_words", "n_removed", "kept", "removed"]).to_batches(max_chunksize=1 << 12)

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """For each row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space), removed (spans of words: start, length).

    A word goes if a window of ``window`` words covers it whose words also start earlier: in a document of a smaller id, or in the same
    one further to the front. Windows are judged on the input. Rows with one id are one document, so equal starts in repeated rows remove
    neither; null ids are one document after all others. A null text has no words; texts of fewer words than a window stay
    whole. Every row of the input gives one row; other columns don't come along. Texts are written once, compressed, in blocks;
    a passage that very many documents share travels once a block.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = written(map_batches(rows, _pack, _BLOCK, most_bytes=BLOCK_BYTES), "blocks")
    anchors = blocks.mapInArrow(_anchors(window, phrase), "hash long, block long, n long")
    again = anchors.withColumn("n", F.sum("n").over(Window.partitionBy("hash"))).where("n > 1")
    listed = again.groupBy("block").agg(
        F.collect_list("hash").alias("recurring"), F.collect_list(F.when(F.col("n") > HOT, F.col("hash"))).alias("hot"))
    kinds = "key long, doc_id long, place long, block long, at long, windows binary"
    candidates = blocks.join(listed, "block").select("block", "payload", "recurring", "hot").mapInArrow(_candidates(window, phrase), kinds)
    marks = candidates.repartition("key").sortWithinPartitions("key", "doc_id", "place").mapInArrow(_confirmed, "block long, mark long")
    found = blocks.join(marks.groupBy("block").agg(F.collect_list("mark").alias("marks")), "block", "left")
    schema = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,length:long>>"
    return found.select("block", "payload", "marks").mapInArrow(_cut(window, phrase), schema)
