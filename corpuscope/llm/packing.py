"""Best-fit packing of tokenised documents into sequences (operator 6).

Documents are cut into pieces of at most ``TOKENS`` ids. A bin is a vector of three capacities: tokens, documents, and
attention cost (the sum of squared piece lengths). Pieces are placed longest first, each into that open bin
in which every constraint holds and the rule's score is best: the smallest weighted norm of what would be left (best
fit), or the largest weighted dot-product of piece and residual.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import (
    character_classes, code_points, give_back, map_batches, row_starts, split_contractions, take_ragged, tokens_as_binary, written,
)

TOKENS = 2048
#: Further capacities. The defaults are what 2,048 tokens can hold at most, so they cost no sequence; lower ones bind.
DOCUMENTS = 2048
ATTENTION = 2048 * 2048
#: Weights of tokens, documents and attention cost in the score.
WEIGHTS = (1.0, 1e-3, 1e-3)
END = 0
#: Pieces that one task packs. A group wastes at most part of one sequence, so larger groups waste less.
GROUP_PIECES = 20_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECE + ", sequence_id long, offset long"
_CACHE_WORDS = 150_000
#: Code points up to here are their own normal form; letters have one lower-case letter, but for one of two code points.
_PLAIN = 0x250
_DOTTED_I = 0x130


class WordTokenizer:
    """Ids as the public word tokenizer gives them. Each distinct word is tokenised once; words are found for a whole batch."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.specials = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.lower = np.array([ord(chr(c).lower()[0]) if c < _PLAIN else c for c in range(_PLAIN)], np.uint32)
        self.byte_text = self._byte_text(sorted(ByteLevel.alphabet()))
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def _byte_text(alphabet: list[str]) -> dict[int, str]:
        """Character that stands for each byte: printable Latin-1 for itself, the rest by number from 256."""
        own = [b for b in range(256) if chr(b) in set(alphabet)]
        rest = [b for b in range(256) if b not in set(own)]
        return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def _word(self, word: bytes) -> bytes:
        """Ids of one word, four bytes each."""
        text = word.decode("latin-1").translate(self.byte_text)
        return np.array([t.id for t in self.library.model.tokenize(text)], np.uint32).tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the n + 1 bounds of each."""
        odd = {i: self.library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if any(s in t for s in self.specials)}
        normal = [("" if i in odd else t) for i, t in enumerate(texts)]
        points, bounds = code_points(normal)
        far = np.add.reduceat(np.append((points >= _PLAIN) | (points == _DOTTED_I), False), bounds[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        far &= np.diff(bounds) > 0
        if far.any():
            for i in np.flatnonzero(far):
                normal[i] = self.library.normalizer.normalize_str(normal[i])
            points, bounds = code_points(normal)
        points = points.copy()
        plain = points < _PLAIN
        points[plain] = self.lower[points[plain]]
        kinds = character_classes()[points]
        first = row_starts(bounds, len(points))
        starts = first | (kinds == 2)
        starts[1:] |= kinds[1:] != kinds[:-1]
        inside = kinds != 3
        starts &= inside
        quotes = np.flatnonzero((points[:-1] == 39) & starts[:-1] & (kinds[1:] == 1) & ~first[1:]) if len(points) else np.zeros(0, np.int64)
        split_contractions(points, kinds, first, starts, quotes)
        words = tokens_as_binary(points, inside, starts).dictionary_encode()
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        found = []
        for word in words.dictionary.to_pylist():
            ids = self.known.get(word)
            if ids is None:
                ids = self.known[word] = self._word(word)
            found.append(ids)
        each = np.append(0, np.cumsum([len(x) // 4 for x in found])).astype(np.int64)
        flat = np.frombuffer(b"".join(found), np.uint32)
        ids, at = take_ragged(flat, each, words.indices.to_numpy())
        bounds = at[np.searchsorted(np.flatnonzero(starts), bounds)]
        if not odd:
            return ids, bounds
        rows = [np.array(odd[i], np.uint32) if i in odd else ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows]))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", tokens: int = TOKENS) -> DataFrame:
    """Pieces of every row's ids and a final ``END``: doc_id, piece, start, length, ids_crc32. Null reads as empty."""

    def run(table: pa.Table) -> pa.Table:
        own = tokenizer(vocabulary)
        texts = [t or "" for t in table.column("text").to_pylist()]
        ids, bounds = own.encode(texts)
        out: list[tuple[int | None, int, int, int, int]] = []
        for name, lo, hi in zip(table.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            row = np.append(ids[lo:hi], END).astype("<u4")
            for k, at in enumerate(range(0, len(row), tokens)):
                part = row[at:at + tokens]
                out.append((name, k, at, len(part), zlib.crc32(part.tobytes())))
        columns = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, _PIECE, most_bytes=2 << 20)


class Bins:
    """Open bins with three capacities, held as arrays of residuals."""

    def __init__(self, capacity: tuple[float, float, float], weights: tuple[float, ...] = WEIGHTS, rule: str = "norm"):
        if rule not in ("norm", "dot"):
            raise ValueError("rule is 'norm' or 'dot'")
        self.capacity, self.weights, self.rule = np.array(capacity, np.float64), np.array(weights), rule
        self.left = np.zeros((1024, 3))
        self.numbers = np.zeros(1024, np.int64)
        self.open, self.count = 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, tokens before it there) for a piece; opens a bin where none fits. A piece above a capacity gets a bin of its own."""
        need = np.array([length, 1, length * length], np.float64)
        left = self.left[:self.open]
        fits = np.flatnonzero((left >= need).all(axis=1))
        if len(fits):
            if self.rule == "norm":
                score = -((((left[fits] - need) / self.capacity) ** 2) @ self.weights)
            else:
                score = (left[fits] / self.capacity) @ (self.weights * need / self.capacity)
            at = int(fits[score.argmax()])
        else:
            if self.open == len(self.left):
                self.left = np.concatenate([self.left, np.zeros_like(self.left)])
                self.numbers = np.append(self.numbers, np.zeros_like(self.numbers))
            at = self.open
            self.left[at], self.numbers[at] = self.capacity, self.count
            self.open += 1
            self.count += 1
        number, offset = int(self.numbers[at]), int(self.capacity[0] - self.left[at, 0])
        self.left[at] -= need
        if (self.left[at] < 1).any():  # full: the last open bin takes its place
            self.open -= 1
            self.left[at], self.numbers[at] = self.left[self.open], self.numbers[self.open]
        return number, offset


def pack_lengths(lengths: np.ndarray, capacity: tuple[float, float, float] = (TOKENS, DOCUMENTS, ATTENTION), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) for each length, longest first."""
    bins, number, offset = Bins(capacity, rule=rule), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        number[i], offset[i] = bins.place(int(lengths[i]))
    return number, offset


def pack(parts: DataFrame, tokens: int = TOKENS, documents: int = DOCUMENTS, attention: int = ATTENTION, rule: str = "norm",
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``parts`` with sequence_id and offset. Pieces are dealt over groups of about ``group_pieces`` by a hash of the document and
    the piece; a group is packed by one task, which holds no more than the group's lengths. Sequence ids are
    unique over all groups."""
    parts = written(parts, "pieces")
    groups = max(1, -(-parts.count() // group_pieces))
    dealt = parts.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                number, offset = pack_lengths(table.column("length").to_numpy(), (tokens, documents, attention), rule)
                full = table.drop(["group"]).append_column("sequence_id", pa.array((group << 32) + number)).append_column("offset", pa.array(offset))
                held.clear()
                yield from full.combine_chunks().to_batches()

        for batch in batches:
            names = batch.column("group").to_numpy()
            for run_ in np.split(np.arange(len(names)), np.flatnonzero(np.diff(names)) + 1):
                if len(run_):
                    if group != int(names[run_[0]]):
                        yield from flush()
                        group = int(names[run_[0]])
                    held.append(batch.slice(int(run_[0]), len(run_)))
        yield from flush()
        give_back()

    tasks = min(groups, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a task takes its groups one after another
    ordered = dealt.repartition(tasks, "group").sortWithinPartitions("group", "doc_id", "piece")
    return ordered.mapInArrow(run, _PACKED)


def pack_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    return pack(pieces(docs, vocabulary, doc_id, text, options.get("tokens", TOKENS)), **options)
