"""Session analyses over call logs: repeated reads, reuse, edits, conversation terms, expiry."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import columns as C
from corpuscope.operators.ranking import running_total, top_k_per_group
from corpuscope.session import cut_lineage

LOOP_WINDOW = "5 minutes"
LOOP_THRESHOLD = 3
EXPIRY = "24 hours"
MAX_CONTEXT_TERMS = 30
TERMS_PER_MESSAGE = 10
HINT = (
    "This file has been read %s times in this session. The indexed chunks are already available: "
    "query specific symbols instead of reading the whole file again."
)


def detect_loops(reads: DataFrame, threshold: int = LOOP_THRESHOLD, window: str = LOOP_WINDOW) -> DataFrame:
    """Running number of each read of a path within 5 minutes of the session's first read of it.

    Later reads count as 1: the window is not moved. reads(session_id, path, ts, id, ...).
    The first read per path is a partial aggregate, and the numbering a distributed prefix sum,
    so a path that one session reads all the time does not fill a single task.
    """
    keys = ["session_id", "path"]
    first = reads.groupBy(*keys).agg(F.min("ts").alias("_first"))
    timed = reads.join(first, keys).withColumn("_in", F.col("ts") < F.col("_first") + F.expr(f"INTERVAL {window}"))
    near = running_total(timed.filter("_in").withColumn("_one", F.lit(1)), ["ts", "id"], "_one", "count", keys)
    far = timed.filter(~F.col("_in")).withColumn("count", F.lit(1).cast("bigint"))
    out = near.drop("_one", "_in", "_first").unionByName(far.drop("_in", "_first"))
    return out.withColumn("looping", F.col("count") >= threshold)


def loop_hints(loops: DataFrame, chars: str = "chars") -> DataFrame:
    """Hint text and tokens saved for looping reads whose output is longer than the hint."""
    hint = F.format_string(HINT, F.col("count"))
    return loops.filter("looping").withColumn("hint", hint).filter(F.length("hint") < F.col(chars)).withColumn(
        "tokens_saved", C.estimate_tokens(F.col(chars) - F.length("hint"))
    )


def not_edited_before(reads: DataFrame, edits: DataFrame) -> DataFrame:
    """Reads of paths that the same session had not edited by then.

    Edits are reduced to the first one per (session, path), so the join has one row per key.
    """
    first = edits.groupBy("session_id", "path").agg(F.min("ts").alias("_edited"))
    return reads.join(first, ["session_id", "path"], "left").filter(
        F.col("_edited").isNull() | (F.col("_edited") > F.col("ts"))
    ).drop("_edited")


def unexpired(rows: DataFrame, as_of: datetime | str, keep: str = EXPIRY, ts: str = "ts") -> DataFrame:
    return rows.filter(F.col(ts) > F.lit(str(as_of)).cast("timestamp") - F.expr(f"INTERVAL {keep}"))


def conversation_terms(messages: DataFrame, limit: int = MAX_CONTEXT_TERMS) -> DataFrame:
    """Distinct recent terms per conversation, oldest first.

    Up to ten words of three or more characters per user message; the last 30 count. Only those
    30 are ever gathered, however long a conversation is.
    """
    tokens = F.slice(
        F.filter(F.split(F.lower("text"), "[^a-z0-9_]+", -1), lambda w: F.length(w) >= 3), 1, TERMS_PER_MESSAGE
    )
    exploded = messages.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.posexplode(tokens).alias("pos", "term")
    )
    last = top_k_per_group(exploded, ["conv_id"], [F.desc("turn"), F.desc("pos")], limit)
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "pos", "term"))), lambda r: r.term
    )
    return last.groupBy("conv_id").agg(F.array_distinct(ordered).alias("terms"))


# ---------------------------------------------------------------- reuse within a time to live


#: Blocks of one time to live that are walked together, without knowing what came before.
CHUNK_BLOCKS = 16
_NEVER = -(2**62)
_MAP = "key string, chunk bigint, ticks binary, newest binary, exit_tick binary, exit_mtime binary"
_ENTRY = "key string, chunk bigint, entry_tick bigint, entry_mtime bigint"


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of equal keys together; batches arrive sorted by them."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        edges = [0, *(np.flatnonzero(new[1:]) + 1).tolist(), len(pdf)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            part = pdf.iloc[lo:hi]
            if held and any(held[-1][k].iloc[0] != part[k].iloc[0] for k in keys):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def next_stores(ticks: np.ndarray, mtimes: np.ndarray, ttl_ms: int) -> np.ndarray:
    """For a store at each tick the position of the next one: the first tick beyond the time to live, or with a newer file."""
    n = len(ticks)
    starts = np.flatnonzero(np.r_[True, mtimes[1:] != mtimes[:-1]]) if n else np.zeros(0, np.int64)
    values, newer, open_ = mtimes[starts].tolist(), np.full(len(starts), n), []
    for run, value in enumerate(values):  # runs of one file time; a file changes far less often than it is read
        while open_ and values[open_[-1]] < value:
            newer[open_.pop()] = starts[run]
        open_.append(run)
    sizes = np.diff(np.r_[starts, n])
    return np.minimum(np.searchsorted(ticks, ticks + ttl_ms, side="right"), np.repeat(newer, sizes))


def first_store(ticks: np.ndarray, newest: np.ndarray, tick: int, mtime: int, ttl_ms: int) -> int:
    """Position of the first store after an entry of (tick, mtime); ``newest``: the running maximum of the file times."""
    return int(min(np.searchsorted(ticks, tick + ttl_ms, side="right"), np.searchsorted(newest, mtime, side="right")))


def _chunk_maps(ttl_ms: int):
    """For each chunk the map from the entry at its start to the entry at its end.

    An entry from before ends within the first time to live of the chunk, so the map is known by the first store in that span: for each
    tick of it, and for none, the last store that follows. There are at most ``ttl_ms`` such ticks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _runs(batches, ["key", "chunk"]):
            ticks, mtimes, chunk = pdf["tick"].to_numpy(np.int64), pdf["mtime"].to_numpy(np.int64), int(pdf["chunk"].iloc[0])
            after = next_stores(ticks, mtimes, ttl_ms)
            last = np.where(after < len(ticks), np.minimum(after, len(ticks) - 1), np.arange(len(ticks)))
            while (last[last] != last).any():
                last = last[last]
            head = int(np.searchsorted(ticks, chunk * CHUNK_BLOCKS * ttl_ms + ttl_ms, side="left"))
            ends = last[:head + 1]
            none = np.full(head + 1 - len(ends), _NEVER, np.int64)  # no store at all: the entry stays what it was
            yield pd.DataFrame({
                "key": [pdf["key"].iloc[0]], "chunk": [chunk], "ticks": [ticks[:head].tobytes()], "newest": [np.maximum.accumulate(mtimes[:head]).tobytes()],
                "exit_tick": [np.r_[ticks[ends], none].tobytes()], "exit_mtime": [np.r_[mtimes[ends], none].tobytes()]})

    return run


def _compose(ttl_ms: int):
    """Entries at the start of each chunk, by following the maps of a key in order; one map is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tick, mtime = None, _NEVER, _NEVER
        for pdf in batches:
            out = []
            for name, chunk, *maps in pdf.itertuples(index=False):
                if name != key:
                    key, tick, mtime = name, _NEVER, _NEVER
                out.append((name, chunk, tick, mtime))
                ticks, newest, exit_tick, exit_mtime = (np.frombuffer(m, np.int64) for m in maps)
                at = first_store(ticks, newest, tick, mtime, ttl_ms)
                if exit_tick[at] != _NEVER:
                    tick, mtime = int(exit_tick[at]), int(exit_mtime[at])
            yield pd.DataFrame(out, columns=["key", "chunk", "entry_tick", "entry_mtime"])

    return run


def _walk(ttl_ms: int):
    """Marks the stores of each chunk, from its known entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _runs(batches, ["key", "chunk"]):
            ticks, mtimes = pdf["tick"].to_numpy(np.int64), pdf["mtime"].to_numpy(np.int64)
            after = next_stores(ticks, mtimes, ttl_ms).tolist()
            at = first_store(ticks, np.maximum.accumulate(mtimes), int(pdf["entry_tick"].iloc[0]), int(pdf["entry_mtime"].iloc[0]), ttl_ms)
            missed = np.zeros(len(pdf), bool)
            while at < len(ticks):
                missed[at] = True
                at = after[at]
            out = pdf[["key", "n", "tokens", "first_tokens"]].copy()
            out["missed"] = missed
            yield out

    return run


def reuse(calls: DataFrame, ttl_ms: int = 300_000) -> DataFrame:
    """Hits and saved tokens per key if outputs were kept for ``ttl_ms`` after they were stored.

    calls(key, ts, id, mtime_ms, tokens). A hit does not renew an entry, and a newer file
    modification time ends it; null tokens count 0. Whether a call hits depends on the calls before it. Time is cut into chunks of ``CHUNK_BLOCKS`` times
    ``ttl_ms``; each (key, chunk) first gives its map from the entry at its start to that at its end, the maps of a key are composed in
    order, and then all chunks are walked from their entries at once. So a key that is called without a pause is dealt over
    as many tasks as it has chunks; only the maps, at most ``ttl_ms`` numbers a chunk, are read in order. Before that, calls are combined
    to one row per key and millisecond.
    """
    ticks = cut_lineage(calls.groupBy("key", F.unix_millis("ts").alias("tick")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.coalesce("mtime_ms", F.lit(0))).cast("bigint").alias("mtime"),
        F.sum(F.coalesce("tokens", F.lit(0))).cast("bigint").alias("tokens"),
        F.min_by(F.coalesce("tokens", F.lit(0)), "id").cast("bigint").alias("first_tokens"),
    ).withColumn("chunk", F.floor(F.col("tick") / (ttl_ms * CHUNK_BLOCKS))))
    order = ["key", "chunk", "tick"]
    maps = (
        ticks.select(*order, "mtime").repartition("key", "chunk").sortWithinPartitions(*order).mapInPandas(_chunk_maps(ttl_ms), _MAP)
    )
    entries = maps.repartition("key").sortWithinPartitions("key", "chunk").mapInPandas(_compose(ttl_ms), _ENTRY)
    walked = (
        ticks.join(entries, ["key", "chunk"]).repartition("key", "chunk").sortWithinPartitions(*order)
        .mapInPandas(_walk(ttl_ms), "key string, n bigint, tokens bigint, first_tokens bigint, missed boolean")
    )
    miss = F.col("missed").cast("int")
    return walked.groupBy("key").agg(
        F.sum("n").alias("calls"),
        (F.sum("n") - F.sum(miss)).alias("hits"),
        F.sum(F.col("tokens") - F.when(F.col("missed"), F.col("first_tokens")).otherwise(0)).alias("tokens_saved"),
    )
