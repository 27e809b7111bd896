"""Hidden Markov language model (operator 7).

Words are emitted in two steps, so that the model stays small while the vocabulary grows with the corpus: a hidden state emits a
word class, the class emits the word by its exact training count. The most frequent words are classes of their own, the others share
one by their ending. The start values come from the counts of neighbouring tokens, Baum-Welch counts (starts, transitions, emissions) from
the recursions; both are gathered by every task over all training texts and summed by Spark. Scoring is the scaled forward recursion over the whole text, which is its exact likelihood.

Counts of all words stay in a table. Only the most frequent ones travel to the tasks; occurrences of the rest are joined with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import ascii_words, give_back, map_batches, most_frequent, regroup, segment_sum, take_ragged, written

STATES = 12
#: Classes: this many frequent words have their own, the endings share so many others; the end of a text has one.
OWN_CLASSES, ENDING_CLASSES = 2047, 2048
CLASSES = OWN_CLASSES + ENDING_CLASSES + 1
#: Words whose counts travel to the tasks.
FREQUENT = 1 << 17
ENDING_BYTES = 3
#: The end of a text; no word holds a white-space byte.
END = b"\n"
#: Baum-Welch: rounds over all training texts, tokens of a block (forward values are kept at block ends), pseudo-counts.
ROUNDS, BLOCK, PSEUDO = 2, 512, 0.01
#: Forward values are scaled once in so many steps: a step takes them down by less than 1e-30, so they stay well within a double.
SCALED = 8
#: Forward values that are held at once, in tokens; a block of fewer texts may be shorter.
CELLS = 1 << 17
#: The start values come from the counts of all neighbouring tokens, in so many coarse classes: frequent words, then the others' classes by remainder.
COARSE, COARSE_OWN = 512, 255
#: Random starts for these counts and their rounds, and the rounds of the best one.
PAIR_STARTS, PAIR_ROUNDS, MORE_ROUNDS = 4, 40, 160
COUNT_ROWS = 600_000
_SCORED = (
    "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, log_classes double, log_states double, "
    "word binary, n long"
)


def held_out(doc_id: Column) -> Column:
    """True where ``crc32(doc_id as text) mod 5`` is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def tokens(column) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts with ``END`` as the last, the number of each token's word, and the n + 1 bounds of the texts' tokens:
    words in order, then the end."""
    found, bounds = ascii_words(column)
    coded = found.dictionary_encode()
    n = len(bounds) - 1
    distinct = pa.concat_arrays([coded.dictionary.cast(pa.large_binary()), pa.array([END], pa.large_binary())])
    out = np.full(len(found) + n, len(distinct) - 1, np.int64)
    place = np.arange(len(found)) + np.repeat(np.arange(n), np.diff(bounds))
    out[place] = coded.indices.to_numpy()
    return distinct, out, bounds + np.arange(n + 1)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of all tokens of ``docs`` (column text), ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def total() -> Iterator[pa.RecordBatch]:
            if held:
                summed = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])
                held.clear()
                yield from summed.combine_chunks().to_batches(max_chunksize=1 << 16)

        for table in regroup(batches, 4 << 20):
            distinct, numbers, _ = tokens(table.column("text"))
            counts = np.bincount(numbers, minlength=len(distinct)).astype(np.int64)
            held.append(pa.table({"word": distinct.cast(pa.binary()), "c": counts}))
            if sum(t.num_rows for t in held) > COUNT_ROWS:
                yield from total()
        yield from total()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Words:
    """The frequent words, most frequent first, and their counts."""

    frequent: pa.Array
    counts: np.ndarray

    def number(self, words: pa.Array) -> np.ndarray:
        """Rank of each word, or -1."""
        return pc.fill_null(pc.index_in(words.cast(pa.large_binary()), value_set=self.frequent), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def classes(self, words: pa.Array, number: np.ndarray | None = None) -> np.ndarray:
        """Class of each word: its own for frequent ones, else that of its last bytes; ``END`` has the last class."""
        number = self.number(words) if number is None else number
        words = words.cast(pa.large_binary())
        bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
        held = words.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(1, np.uint8)
        ending, sizes = np.zeros(len(words), np.uint64), np.diff(bounds)
        for k in range(1, ENDING_BYTES + 1):
            byte = np.where(sizes >= k, data[np.maximum(bounds[1:] - k, 0)], 0)
            ending = ending << np.uint64(8) | byte.astype(np.uint64)
        shared = (ending * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(ENDING_CLASSES)
        out = np.where((number >= 0) & (number < OWN_CLASSES), number, OWN_CLASSES + shared.astype(np.int64))
        if len(words):
            out[(sizes == 1) & (data[np.minimum(bounds[:-1], len(data) - 1)] == END[0])] = CLASSES - 1
        return out


@dataclass
class Chain:
    """Start, transition and emission probabilities; emission is (classes, states)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def forward(self, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural log-likelihood of each sequence of classes; 0 for an empty one."""
        order, live = _by_length(bounds)
        begin, out = bounds[:-1][order], np.zeros(len(order))
        alpha = np.empty((0, len(self.start)))
        for t, (n, m) in enumerate(zip(live, [*live[1:], 0], strict=False)):
            seen = self.emit.take(classes[begin[:n] + t], axis=0)
            alpha = (alpha[:n] @ self.move if t else self.start) * seen
            if t % SCALED == SCALED - 1:
                scale = alpha.sum(axis=1)
                alpha /= scale[:, None]
                out[order[:n]] += np.log(scale)
            if m < n:  # sequences that end here
                out[order[m:n]] += np.log(alpha[m:].sum(axis=1))
        return out

    def usual(self) -> np.ndarray:
        """Long-run share of each state."""
        share = self.start
        for _ in range(200):
            share = share @ self.move
        return share / share.sum()

    def expect(self, classes: np.ndarray, bounds: np.ndarray, counts: Counts, first: np.ndarray | None = None) -> None:
        """Add the expected counts of all sequences. Those that ``first`` doesn't mark begin amid a text: they have no start to count.

        Memory follows ``BLOCK``: forward values are kept at block ends only and found again block by block on the way back.
        """
        order, live = _by_length(bounds)
        begin, k = bounds[:-1][order], len(self.start)
        first = np.ones(len(order), bool) if first is None else first[order]
        start = np.where(first[:, None], self.start, self.usual()) if not first.all() else np.broadcast_to(self.start, (len(order), k))
        back = np.ascontiguousarray(self.move.T)

        def onward(at: int, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
            """Classes, emissions and forward values of a block, step by step, and the bounds of its steps. Forward values are scaled at every
            ``SCALED``-th step, whose emissions hold the scale too."""
            sizes = np.array(live[at:at + BLOCK])
            ends = np.append(0, np.cumsum(sizes))
            row = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
            place = classes[begin[row] + np.repeat(np.arange(at, at + len(sizes)), sizes)]
            seen = self.emit.take(place, axis=0)
            alphas, ends = np.empty_like(seen), ends.tolist()
            for t, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True), at):
                now, emitted = alphas[lo:hi], seen[lo:hi]
                if t:
                    np.matmul(alpha[:hi - lo], self.move, out=now)
                    now *= emitted
                else:
                    np.multiply(start[:hi - lo], emitted, out=now)
                if t % SCALED == SCALED - 1:
                    scale = 1 / now.sum(axis=1, keepdims=True)
                    now *= scale
                    emitted *= scale
                alpha = now
            return place, seen, alphas, ends

        heads = [start]
        cuts = range(0, len(live), BLOCK)
        for at in cuts[:-1]:
            _, _, alphas, ends = onward(at, heads[-1])
            heads.append(alphas[ends[-2]:].copy())
        ahead, pairs = np.ones((0, k)), np.zeros((k, k))
        for at, head in zip(reversed(cuts), reversed(heads), strict=False):
            place, seen, alphas, ends = onward(at, head)
            for lo, hi in zip(reversed(ends[:-1]), reversed(ends[1:]), strict=True):
                n, m, alpha = hi - lo, len(ahead), alphas[lo:hi]
                beta = np.empty((n, k))
                if m:
                    pairs += alpha[:m].T @ ahead
                    np.matmul(ahead, back, out=beta[:m])
                if m < n:  # sequences that end here
                    beta[m:] = 1 / alpha[m:].sum(axis=1, keepdims=True)
                ahead = seen[lo:hi]
                ahead *= beta
                alpha *= beta  # from here on the share of each state
            if at == 0:
                counts.start += alphas[:ends[1]][first[:live[0]]].sum(axis=0)
            by_class = np.argsort(place.astype(np.uint16), kind="stable")
            place = place[by_class]
            heads_of = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            counts.emit[place[heads_of]] += np.add.reduceat(alphas.take(by_class, axis=0), heads_of, axis=0)
            ahead = ahead.copy()  # not the block it lies in
        counts.move += self.move * pairs


@dataclass
class Counts:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def zero(cls, states: int = STATES) -> Counts:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states)))

    def chain(self) -> Chain:
        share = lambda x, axis: (x + PSEUDO) / (x + PSEUDO).sum(axis=axis, keepdims=True)
        return Chain(share(self.start, 0), share(self.move, 1), share(self.emit, 0))


def _by_length(bounds: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Sequences, longest first, and how many have a token at each step."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max()) if len(sizes) else 0
    live = np.searchsorted(-sizes[order], -np.arange(longest), "left")
    return order, live.tolist()


def coarse(classes: np.ndarray) -> np.ndarray:
    """Coarse class of each class: frequent words have their own, the others share the rest."""
    return np.where(classes < COARSE_OWN, classes, COARSE_OWN + classes % (COARSE - COARSE_OWN))


def start_chain(pairs: np.ndarray, mass: np.ndarray, states: int = STATES) -> Chain:
    """Start values from the counts of all neighbouring tokens of all texts. ``pairs`` (COARSE + 1, COARSE): how often a coarse class
    follows another; the last row counts the first tokens of texts. ``mass``: tokens of each class.

    Expectation maximization over the pairs, each a sequence of two; the best of a few random starts goes on. Within a coarse class the
    classes keep their shares."""
    follows, begins = pairs[:-1], pairs[-1]
    share = lambda x, axis: (x + PSEUDO) / (x + PSEUDO).sum(axis=axis, keepdims=True)
    either = follows.sum(axis=0) + follows.sum(axis=1) + begins

    def rounds(usual: np.ndarray, move: np.ndarray, emit: np.ndarray, n: int) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        value = 0.0
        for _ in range(n):
            left = emit * usual  # (COARSE, states): class and state of the first token
            after = left @ move
            likely = after @ emit.T
            value = float((follows * np.log(likely)).sum())
            ratio = follows / likely
            back = ratio @ emit
            moved = move * (left.T @ back)
            first, second = left * (back @ move.T), emit * (ratio.T @ after)
            usual, move, emit = share(first.sum(axis=0), 0), share(moved, 1), share(first + second, 0)
        return value, (usual, move, emit)

    rng = np.random.default_rng(0)
    best = None
    for _ in range(PAIR_STARTS):
        emit = share((either[:, None] + 1) * rng.random((COARSE, states)), 0)
        move = share(0.5 * np.eye(states) + 0.5 / states, 1)
        found = rounds(np.full(states, 1 / states), move, emit, PAIR_ROUNDS)
        best = found if best is None or found[0] > best[0] else best
    usual, move, emit = rounds(*best[1], MORE_ROUNDS)[1]
    own = coarse(np.arange(CLASSES))
    part = (mass + PSEUDO) / np.bincount(own, weights=mass + PSEUDO, minlength=COARSE)[own]
    belongs = emit * usual
    start = begins @ (belongs / belongs.sum(axis=1, keepdims=True))
    return Chain(share(start, 0), move, share(emit[own] * part[:, None] * max(1.0, mass.sum()), 0))


@dataclass
class Model:
    words: Words
    chain: Chain
    log_class: np.ndarray  # log10 of each class's mass, N + 0.5 (V + 1)
    train_tokens: int
    log_total: float  # the same of all training tokens


def _classes_of(words: Words, column) -> tuple[np.ndarray, np.ndarray]:
    distinct, numbers, bounds = tokens(column)
    return words.classes(distinct)[numbers], bounds


def classed(docs: DataFrame, words: Words) -> DataFrame:
    """All texts of ``docs`` as the classes of their tokens, written once for all rounds: (classes binary, 16 bits a token). Beside them
    rows (a, b, n) without classes: how often coarse class b follows a in a task's texts; a is COARSE where b begins a text."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # bounded by FREQUENT
    names = ["classes", "a", "b", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((COARSE + 1) * COARSE, np.int64)
        for table in regroup(batches, 2 << 20):
            classes, bounds = _classes_of(shared.value, table.column("text"))
            near = coarse(classes)
            before = np.append(COARSE, near[:-1])
            before[bounds[:-1]] = COARSE  # every text has its end as a token
            pairs += np.bincount(before * COARSE + near, minlength=len(pairs))
            held = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(2 * bounds), pa.py_buffer(classes.astype("<i2"))]).cast(pa.binary())
            none = pa.nulls(len(held), pa.int64())
            yield pa.RecordBatch.from_arrays([held, none.cast(pa.int32()), none.cast(pa.int32()), none], names)
        seen = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.binary()), pa.array((seen // COARSE).astype(np.int32)),
                                          pa.array((seen % COARSE).astype(np.int32)), pa.array(pairs[seen])], names)

    return written(docs.select("text").mapInArrow(run, "classes binary, a int, b int, n long"), "classes")


def pair_counts(texts: DataFrame) -> np.ndarray:
    """(COARSE + 1, COARSE) counts of ``classed`` texts; so many rows at most come to the driver."""
    found = texts.where("classes is null").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((COARSE + 1, COARSE))
    out[found.column("a").to_numpy(), found.column("b").to_numpy()] = found.column("n").to_numpy()
    return out


def round_counts(texts: DataFrame, chain: Chain) -> Counts:
    """Expected counts over all ``classed`` texts: each task adds its own up, Spark sums them by class."""
    states = len(chain.start)
    shared = texts.sparkSession.sparkContext.broadcast(chain)  # bounded by CLASSES and STATES
    columns = [f"s{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_chain = shared.value
        total = Counts.zero(states)
        for table in regroup(batches, 8 << 20):  # of many texts few are alone at their last tokens
            held = table.column("classes").combine_chunks().cast(pa.large_binary())
            bounds = np.frombuffer(held.buffers()[1], np.int64)[held.offset:held.offset + len(held) + 1] // 2
            classes = np.frombuffer(held.buffers()[2], "<i2")[bounds[0]:bounds[-1]]
            bounds = bounds - bounds[0]
            order = np.argsort(-np.diff(bounds), kind="stable")  # texts of like length go together
            at = 0
            while at < len(order):
                step = max(64, CELLS // min(BLOCK, int(bounds[order[at] + 1] - bounds[order[at]])))
                own_chain.expect(*take_ragged(classes, bounds, order[at:at + step]), total)
                at += step
        rows = np.concatenate([total.emit, total.move, total.start[None, :]])
        seen = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *(pa.array(rows[seen, k]) for k in range(states))], ["row", *columns])
        give_back()

    kinds = "row int, " + ", ".join(f"{c} double" for c in columns)
    found = texts.where("classes is not null").select("classes").mapInArrow(run, kinds)
    summed = found.groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).collect()
    rows = np.zeros((CLASSES + states + 1, states))
    for r in summed:
        rows[r["row"]] = [r[c] for c in columns]
    return Counts(rows[-1], rows[CLASSES:CLASSES + states], rows[:CLASSES])


def train(docs: DataFrame, counts: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Learn from the texts of ``docs`` (doc_id, text), whose words ``counts`` (word, c) has."""
    top = sorted(most_frequent(counts, "c", FREQUENT).collect(), key=lambda r: (-r["c"], bytes(r["word"])))
    words = Words(pa.array([bytes(r["word"]) for r in top], pa.large_binary()), np.array([r["c"] for r in top], np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(words)  # bounded by FREQUENT

    def by_class(table: pa.Table) -> pa.Table:
        own = shared.value.classes(table.column("word").combine_chunks().cast(pa.large_binary()))
        n, v = np.bincount(own, weights=table.column("c").to_numpy(), minlength=CLASSES), np.bincount(own, minlength=CLASSES)
        seen = np.flatnonzero(v)
        return pa.table({"class": seen.astype(np.int32), "n": n[seen].astype(np.int64), "v": v[seen].astype(np.int64)})

    mass = map_batches(counts.select("word", "c"), by_class, "class int, n long, v long").groupBy("class").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in mass:
        n[r["class"]], v[r["class"]] = r["n"], r["v"]

    total = int(n.sum())
    texts = classed(docs, words)
    chain = start_chain(pair_counts(texts), n, states)
    for _ in range(rounds):
        chain = round_counts(texts, chain).chain()
    return Model(words, chain, np.log10(n + 0.5 * (v + 1)), total, float(np.log10(total + 0.5 * (v.sum() + 1))))


def _score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        uid = TaskContext.get().partitionId() << 33
        for table in regroup(batches, 4 << 20):
            distinct, numbers, bounds = tokens(table.column("text"))
            rank = model.words.number(distinct)
            classes = model.words.classes(distinct, rank)
            known = rank >= 0
            logs = np.where(known, np.log10(model.words.counts[np.maximum(rank, 0)] + 0.5) if len(model.words.counts) else 0.0, 0.0)
            n = table.num_rows
            ids = uid + np.arange(n)
            uid += n
            yield pa.RecordBatch.from_arrays([
                pa.array(ids), table.column("doc_id").combine_chunks().cast(pa.int64()), table.column("held_out").combine_chunks(),
                pa.array(np.diff(bounds)), pa.array(segment_sum(known[numbers].astype(np.int64), bounds)),
                pa.array(segment_sum(logs[numbers], bounds)), pa.array(segment_sum(model.log_class[classes][numbers], bounds)),
                pa.array(model.chain.forward(classes[numbers], bounds) / np.log(10)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()),
            ], _NAMES)
            rare = np.flatnonzero(~known[numbers])
            owner = np.searchsorted(bounds, rare, "right") - 1
            pairs, times = np.unique(owner * len(distinct) + numbers[rare], return_counts=True)
            for at in range(0, len(pairs), 1 << 17):
                part = pairs[at:at + (1 << 17)]
                m = len(part)
                none = lambda kind: pa.nulls(m, kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[part // len(distinct)]), none(pa.int64()), none(pa.bool_()), none(pa.int64()), none(pa.int64()),
                    none(pa.float64()), none(pa.float64()), none(pa.float64()),
                    distinct.take(pa.array(part % len(distinct))).cast(pa.binary()), pa.array(times[at:at + m]),
                ], _NAMES)

    return run


_NAMES = [c.split()[0] for c in _SCORED.split(", ")]


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, held_out): n_tokens, n_known, train_tokens, base_score and score (log10).

    Null reads as empty: one token, the end. A row's frequent words are scored where it is read; its other words are dealt by word, joined with
    their counts and summed up by row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FREQUENT, CLASSES and STATES
    both = written(docs.select("doc_id", "text", "held_out").mapInArrow(_score_batches(shared), _SCORED), "scored")
    rows = both.where("word is null").drop("word", "n")
    rare = (
        both.where("word is not null").select("uid", "word", "n").join(counts, "word", "left").groupBy("uid").agg(
            F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5) * F.col("n")).alias("more_logs"))
    )
    logs = F.col("log_counts") + F.coalesce("more_logs", F.lit(0.0))
    return rows.join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * model.log_total).alias("base_score"),
        (F.col("log_states") + logs - F.col("log_classes")).alias("score"))


def train_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on all texts that are not held out, score all. Rows with a null id are not held out."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out(F.col(doc_id)).alias("held_out"))
    learned = rows.where(~F.col("held_out"))
    counts = written(count_words(learned), "words")
    return score(rows, counts, train(learned, counts))
