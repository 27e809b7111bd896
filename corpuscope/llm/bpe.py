"""Byte-level BPE by a minimal acyclic transducer lexicon (operator 8).

The frequent words of the corpus and their ids are compiled into a minimal acyclic automaton: words share suffixes as well as
prefixes, and the outputs on a word's arcs add up to its number, which leads to its ids. The file is handed to every
executor and memory-mapped. All distinct words of a batch walk it together, one byte per step; words that it
lacks are merged exactly, again all together.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import (
    character_classes, code_points, map_batches, most_frequent, publish, published, regroup, row_starts, split_contractions,
    take_ragged, tokens_as_binary, written,
)

LEXICON_WORDS = 1 << 16
#: Longer words are merged one at a time, by a heap.
LONG_WORD = 128
#: Symbols of the words that are merged together.
BLOCK_CELLS = 1 << 19
#: Counts of one task are combined when so many rows are held.
COUNT_ROWS = 600_000
_NONE = np.int64(1) << 40
_MAGIC = b"MAT1"


class HashTable:
    """Int64 keys to rows by open addressing; whole arrays are looked up at once."""

    def __init__(self, slots: np.ndarray, rows: np.ndarray, probes: int):
        self.slots, self.rows, self.probes, self.mask = slots, rows, probes, np.uint64(len(slots) - 1)

    @staticmethod
    def place(keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mixed ^ (mixed >> np.uint64(29))

    @classmethod
    def build(cls, keys: np.ndarray) -> HashTable:
        size = 1 << max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        slots, rows = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        open_, at, probes = np.arange(len(keys)), (cls.place(keys) >> np.uint64(20)) & np.uint64(size - 1), 1
        while True:
            free = slots[at] < 0
            take, first = np.unique(at[free], return_index=True)
            own = np.flatnonzero(free)[first]
            slots[take], rows[take] = keys[open_[own]], open_[own]
            left = np.ones(len(open_), bool)
            left[own] = False
            if not left.any():
                return cls(slots, rows, probes)
            open_, at, probes = open_[left], (at[left] + np.uint64(1)) & np.uint64(size - 1), probes + 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        at = (self.place(keys) >> np.uint64(20)) & self.mask
        got = self.slots[at]
        out = np.where(got == keys, self.rows[at], -1)
        open_ = np.flatnonzero((got != keys) & (got >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            here = (at[open_] + np.uint64(step)) & self.mask
            got = self.slots[here]
            hit = got == keys[open_]
            out[open_[hit]] = self.rows[here[hit]]
            open_ = open_[~hit & (got >= 0)]
        return out


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        names, merges = content["model"]["vocab"], content["model"]["merges"]
        byte_of = self._byte_of(names)
        self.specials = {t["content"]: t["id"] for t in content["added_tokens"]}
        size = 1 + max([*names.values(), *self.specials.values()])
        text = [b""] * size
        for name, i in names.items():
            text[i] = bytes(byte_of[c] for c in name)
        for name, i in self.specials.items():
            text[i] = name.encode()
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_bounds = np.append(0, np.cumsum([len(t) for t in text])).astype(np.int64)
        self.of_byte = np.zeros(256, np.int64)
        for char, byte in byte_of.items():
            self.of_byte[byte] = names[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left, right = np.array([names[a] for a, _ in pairs], np.int64), np.array([names[b] for _, b in pairs], np.int64)
        self.merged = np.array([names[a + b] for a, b in pairs], np.int64)
        self.table = HashTable.build(left << 20 | right)

    @staticmethod
    def _byte_of(names: dict[str, int]) -> dict[str, int]:
        """Byte of each character: printable Latin-1 stands for itself, the other bytes follow from 256 on in order."""
        own = {chr(b): b for b in range(256) if b in range(33, 127) or b in range(161, 256) and b != 173}
        rest = (b for b in range(256) if b not in own.values())
        return own | {chr(256 + k): b for k, b in enumerate(rest)}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.table.find(left << 20 | right)
        return np.where(found < 0, _NONE, found)

    def merge(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word (bytes, bounds) by exact merging, lowest rank first and leftmost of equals; ragged (ids, bounds)."""
        sizes = np.diff(bounds)
        out: list[np.ndarray | None] = [None] * len(sizes)
        order = np.argsort(sizes, kind="stable")
        lo = int(np.searchsorted(sizes[order], 1))
        for i in order[:lo]:
            out[i] = np.zeros(0, np.int64)
        while lo < len(order):
            least = int(sizes[order[lo]])  # words of like sizes go together, as many as fit a block of cells
            hi = int(np.searchsorted(sizes[order], 2 * least, "right"))
            hi = min(hi, lo + max(1, BLOCK_CELLS // (2 * least)))
            width = int(sizes[order[hi - 1]])
            if width > LONG_WORD:
                for i in order[lo:hi]:
                    out[i] = self._merge_long(data[bounds[i]:bounds[i + 1]])
            else:
                rows = order[lo:hi]
                ids, counts = self._merge_block(data, bounds[rows], sizes[rows], width)
                for k, i in enumerate(rows.tolist()):
                    out[i] = ids[k, :counts[k]]
            lo = hi
        each = np.append(0, np.cumsum([len(x) for x in out])).astype(np.int64)
        return (np.concatenate(out) if out else np.zeros(0, np.int64)), each

    def _merge_block(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        columns = np.arange(width)
        inside = columns[None, :] < sizes[:, None]
        symbols = np.where(inside, self.of_byte[data[np.minimum(starts[:, None] + columns, len(data) - 1)]], 0)
        counts = sizes.copy()
        ranks = np.full((len(sizes), width), _NONE, np.int64)
        if width > 1:
            pair = inside[:, 1:]
            ranks[:, :-1][pair] = self.rank(symbols[:, :-1][pair], symbols[:, 1:][pair])
        result, live = symbols.copy(), np.arange(len(sizes))
        symbols = symbols.copy()
        while len(live):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(live)), at]
            going = least < _NONE
            if not going.all():
                result[live[~going]] = symbols[~going]
                live, symbols, ranks, at, least = live[going], symbols[going], ranks[going], at[going], least[going]
                if not len(live):
                    break
            rows = np.arange(len(live))
            shift = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width - 1)
            symbols, ranks = np.take_along_axis(symbols, shift, axis=1), np.take_along_axis(ranks, shift, axis=1)
            symbols[rows, at] = self.merged[least]
            counts[live] -= 1
            last = counts[live] - 1  # the last symbol has no pair to its right
            ranks[:, -1] = _NONE
            ranks[rows, last] = _NONE
            for place, fits in ((at, at < last), (at - 1, at > 0)):
                r = rows[fits]
                p = place[fits]
                ranks[r, p] = self.rank(symbols[r, p], symbols[r, p + 1])
        return result, counts

    def _merge_long(self, word: np.ndarray) -> np.ndarray:
        symbols = self.of_byte[word].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.rank(np.array(symbols[:-1]), np.array(symbols[1:])).tolist()
        heap = [(r, i, symbols[i], symbols[i + 1]) for i, r in enumerate(ranks) if r < _NONE]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n:
                r = int(self.rank(np.array([symbols[i]]), np.array([symbols[j]]))[0])
                if r < _NONE:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([s for s in symbols if s >= 0], np.int64)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of the texts in UTF-8, and the n + 1 bounds of each text's: contractions, runs of letters, numbers or other signs with
    one space before them, and white space; of white space before a word the last one stands alone."""
    points, bounds = code_points(texts)
    n = len(points)
    if not n:
        return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64)
    kinds = character_classes()[points]
    first = row_starts(bounds, n)
    starts = first.copy()
    starts[1:] |= kinds[1:] != kinds[:-1]
    white = kinds == 3
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:])  # white space before a word of the same text
    starts[last] = True
    starts[last[points[last] == 32] + 1] = False
    quotes = np.flatnonzero((points[:-1] == 39) & starts[:-1] & (kinds[1:] == 1) & ~first[1:])
    split_contractions(points, kinds, first, starts, quotes)
    found = tokens_as_binary(points, np.ones(n, bool), starts)
    return found, np.searchsorted(np.flatnonzero(starts), bounds)


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The automaton of the words and their ids as one file. States with the same continuations are one."""
    register: dict[tuple, int] = {}
    finals, arcs, sizes = [], [], []  # of each registered state: is a word's end, ((byte, state), ...), words below

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = register.get(key)
        if state is None:
            state = register[key] = len(finals)
            finals.append(node[0])
            arcs.append(key[1])
            sizes.append(node[0] + sum(sizes[s] for _, s in key[1]))
        return state

    path: list[list] = [[0, []]]  # open states along the last word; each arc's end is added when it is frozen
    last = b""
    ordered = sorted(entries)
    for word in [*ordered, None]:
        common = 0
        if word is not None:
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
        for depth in range(len(last), common, -1):
            state = freeze(path.pop())
            path[-1][1].append((last[depth - 1], state))
        if word is not None:
            path += [[0, []] for _ in range(len(word) - common)]
            path[-1][0] = 1
            last = word
    root = freeze(path[0])
    keys, ends, adds = [], [], []
    for state, own in enumerate(arcs):
        below = finals[state]
        for byte, end in own:
            keys.append(state << 8 | byte)
            ends.append(end)
            adds.append(below)
            below += sizes[end]
    table = HashTable.build(np.array(keys, np.int64))
    ids = [entries[w] for w in ordered]
    parts = [
        table.slots, table.rows.astype(np.int64), np.array(ends, np.int64), np.array(adds, np.int64), np.array(finals, np.int64),
        np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int64), np.array([i for x in ids for i in x], np.int64),
    ]
    head = struct.pack("<4s2q7q", _MAGIC, root, table.probes, *map(len, parts)).ljust(96, b"\0")
    return head + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled file, memory-mapped."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        magic, self.root, probes, *sizes = struct.unpack("<4s2q7q", raw[:76].tobytes())
        if magic != _MAGIC:
            raise ValueError(f"{path} is no lexicon")
        at, parts = 96, []
        for n in sizes:
            parts.append(raw[at:at + 8 * n].view(np.int64))
            at += 8 * n
        slots, rows, self.ends, self.adds, self.finals, self.bounds, self.ids = parts
        self.table = HashTable(slots, rows, probes)

    def find(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Number of each word (bytes, bounds), or -1 where the lexicon lacks it."""
        sizes = np.diff(bounds)
        out = np.full(len(sizes), -1, np.int64)
        live = np.flatnonzero(sizes > 0)
        state, number = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            arc = self.table.find(state << 8 | data[bounds[live] + step].astype(np.int64))
            on = arc >= 0
            live, arc = live[on], arc[on]
            state, number = self.ends[arc], number[on] + self.adds[arc]
            step += 1
            done = sizes[live] == step
            ended = done & (self.finals[state] == 1)
            out[live[ended]] = number[ended]
            live, state, number = live[~done], state[~done], number[~done]
        return out


@lru_cache(maxsize=4)
def _opened(path: str) -> Lexicon:
    return Lexicon(path)


class Codec:
    """Encoder and decoder of one vocabulary file, with or without a lexicon."""

    def __init__(self, vocabulary_path: str, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary(vocabulary_path), lexicon

    def word_ids(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each distinct word: from the lexicon, else by merging."""
        distinct = distinct.cast(pa.large_binary())
        bounds = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset:distinct.offset + len(distinct) + 1]
        held = distinct.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(1, np.uint8)
        number = np.full(len(distinct), -1, np.int64) if self.lexicon is None else self.lexicon.find(data, bounds)
        new = np.flatnonzero(number < 0)
        gathered, own = take_ragged(data, bounds, new) if len(new) else (data[:0], np.zeros(1, np.int64))
        merged, merged_bounds = self.vocabulary.merge(gathered, own)
        if self.lexicon is None:
            return merged, merged_bounds
        # one ragged table: the lexicon's words, then the merged ones
        row = number.copy()
        row[new] = len(self.lexicon.bounds) - 1 + np.arange(len(new))
        values = np.concatenate([self.lexicon.ids, merged])
        table = np.concatenate([self.lexicon.bounds, len(self.lexicon.ids) + merged_bounds[1:]])
        return take_ragged(values, table, row)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, bounds = words(texts)
        coded = found.dictionary_encode()
        ids, each = self.word_ids(coded.dictionary)
        flat, at = take_ragged(ids, each, coded.indices.to_numpy())
        return flat, at[bounds]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their n + 1 bounds. A special token's text is that token, wherever it stands."""
        specials = self.vocabulary.specials
        odd = [i for i, t in enumerate(texts) if any(s in t for s in specials)]
        if not odd:
            return self._plain(texts)
        parts: list[list[str | int]] = []
        for text in texts:
            row: list[str | int] = [text]
            for name, number in sorted(specials.items(), key=lambda s: -len(s[0])):
                row = [x for piece in row for x in ([piece] if isinstance(piece, int) else _between(piece.split(name), number))]
            parts.append(row)
        flat, bounds = self._plain([p for row in parts for p in row if isinstance(p, str)])
        out, at = [], 0
        for row in parts:
            own = []
            for piece in row:
                if isinstance(piece, int):
                    own.append(np.array([piece], np.int64))
                else:
                    own.append(flat[bounds[at]:bounds[at + 1]])
                    at += 1
            out.append(np.concatenate(own))
        return np.concatenate(out), np.append(0, np.cumsum([len(x) for x in out]))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; broken sequences become replacement characters."""
        raw, _ = take_ragged(self.vocabulary.text, self.vocabulary.text_bounds, ids)
        return raw.tobytes().decode("utf-8", "replace").encode()


def _between(pieces: list[str], number: int) -> list[str | int]:
    out: list[str | int] = [pieces[0]]
    for piece in pieces[1:]:
        out += [number, piece]
    return out


def build_lexicon(docs: DataFrame, vocabulary_path: str, text: str = "text", size: int = LEXICON_WORDS) -> str:
    """Count the words of all documents, compile the most frequent ones (at most ``size``) and hand the file out; its name."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def total() -> Iterator[pa.RecordBatch]:
            if held:
                summed = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                held.clear()
                yield from summed.combine_chunks().to_batches(max_chunksize=1 << 16)

        for table in regroup(batches, 2 << 20):
            found, _ = words([t or "" for t in table.column("text").to_pylist()])
            coded = found.dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(np.int64)
            held.append(pa.table({"word": coded.dictionary.cast(pa.binary()), "n": pa.array(n)}))
            rows += len(n)
            if rows > COUNT_ROWS:
                yield from total()
                rows = 0
        yield from total()

    counts = docs.select(F.col(text).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts.where(F.length("word") <= LONG_WORD), "words")
    top = sorted(bytes(r["word"]) for r in most_frequent(counts, "n", size).collect())
    ids, bounds = Codec(vocabulary_path).word_ids(pa.array(top, pa.large_binary()))
    entries = {w: ids[bounds[i]:bounds[i + 1]].tolist() for i, w in enumerate(top)}
    return publish(docs.sparkSession, "lexicon", compile_lexicon(entries))


def round_trip(docs: DataFrame, vocabulary_path: str, lexicon: str | None, doc_id: str = "doc_id", text: str = "text",
               with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row (and ``ids`` if asked for). Null reads as empty, and an
    empty text has no ids. No shuffle."""

    def run(table: pa.Table) -> pa.Table:
        codec = Codec(vocabulary_path, None if lexicon is None else _opened(published(lexicon)))
        ids, bounds = codec.encode([t or "" for t in table.column("text").to_pylist()])
        digests, decoded, lists = [], [], []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            digests.append(hashlib.sha256(ids[lo:hi].astype("<u4").tobytes()).hexdigest())
            decoded.append(hashlib.sha256(codec.decode(ids[lo:hi])).hexdigest())
            if with_ids:
                lists.append(ids[lo:hi].astype(np.int32))
        out = {"doc_id": table.column("doc_id"), "n_tokens": pa.array(np.diff(bounds).astype(np.int64)),
               "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
        return pa.table(out | ({"ids": pa.array(lists, pa.list_(pa.int32()))} if with_ids else {}))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(rows, run, kind + (", ids array<int>" if with_ids else ""), most_bytes=2 << 20)
