"""Live detection of repeated reads, the read-after-edit guard, and expiry of session edits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpuscope.operators.sessions import LOOP_THRESHOLD

WINDOW_MS = 5 * 60 * 1000
KEEP_MS = 24 * 60 * 60 * 1000
#: Numbers of an entry of a waiting list: state is read and written entry by entry.
PACK = 1 << 16
NEVER = -(1 << 62)
OUTPUT = "session_id string, path string, ts timestamp, count bigint, looping boolean"


def _pack(numbers: np.ndarray) -> list[tuple[bytes]]:
    """Entries of a waiting list that hold the numbers."""
    return [(numbers[i:i + PACK].astype("<i8").tobytes(),) for i in range(0, len(numbers), PACK)]


def _unpack(entries) -> np.ndarray:
    """The numbers of a waiting list, in order."""
    return np.sort(np.concatenate([np.empty(0, "<i8"), *(np.frombuffer(bytes(e[0]), "<i8") for e in entries)]))


class ReadCounter(StatefulProcessor):
    """Per (session, path): time of the first read and the number of reads near it.

    Reads wait until the watermark has passed them and are then numbered in order of time, so the result doesn't depend on
    how they fall into micro-batches. State is two numbers for each key and the reads within the lateness;
    ``keep_ms`` frees the numbers so long after the first read, and the next read then counts as a first one.
    """

    def __init__(self, threshold: int = LOOP_THRESHOLD, keep_ms: int | None = None):
        self.threshold, self.keep_ms = threshold, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("reads", "first_ms bigint, seen bigint")
        self.waiting = handle.getListState("waiting", "packed binary")

    def _rows(self, key, micros: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({
            "session_id": pd.Series([key[0]] * len(micros), dtype="object"), "path": pd.Series([key[1]] * len(micros), dtype="object"),
            "ts": pd.to_datetime(pd.Series(micros, dtype="int64"), unit="us"), "count": pd.Series(counts, dtype="int64"),
            "looping": pd.Series(counts >= self.threshold, dtype="bool"),
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for part in rows:
            micros = part["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            if len(micros):
                self.waiting.appendList(_pack(micros))
                least = int(micros.min()) if least is None else min(least, int(micros.min()))
        if least is not None:
            self.handle.registerTimer(max(least // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        yield self._rows(key, np.empty(0, "int64"), np.empty(0, "int64"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        held = _unpack(self.waiting.get())
        due, rest = np.split(held, [np.searchsorted(held, limit, "right")])
        if len(rest):
            self.waiting.put(_pack(rest))
            self.handle.registerTimer(max(int(rest[0]) // 1000, limit // 1000) + 1)
        else:
            self.waiting.clear()
        first, seen = self.state.get() if self.state.exists() else (None, 0)
        millis, counts, at = due // 1000, np.ones(len(due), "int64"), 0
        while at < len(due):  # one turn for each first read
            if first is None or (self.keep_ms is not None and millis[at] - first >= self.keep_ms):
                first, seen = int(millis[at]), 0
            end = len(due) if self.keep_ms is None else max(at + 1, int(np.searchsorted(millis, first + self.keep_ms)))
            near = millis[at:end] - first < WINDOW_MS
            counts[at:end] = np.where(near, seen + np.cumsum(near), 1)
            seen, at = seen + int(near.sum()), end
        if len(due):
            self.state.update((first, seen))
        if self.keep_ms is not None and first is not None and not len(rest) and limit // 1000 - first >= self.keep_ms:
            self.state.clear()
        yield self._rows(key, due, counts)

    def close(self) -> None:
        pass


def live_loops(reads: DataFrame, late: str = "1 minute", threshold: int = LOOP_THRESHOLD, keep_ms: int | None = None) -> DataFrame:
    """reads(session_id, path, ts) with their running count near the first read, once the watermark has passed them.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return (
        reads.withWatermark("ts", late).groupBy("session_id", "path")
        .transformWithStateInPandas(
            ReadCounter(threshold, keep_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime",
        )
    )


def recent_edits(edits: DataFrame, keep: str = "24 hours") -> DataFrame:
    """First edit per (session, path); the watermark forgets edits after ``keep``."""
    return edits.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["session_id", "path"])


class EditGuard(StatefulProcessor):
    """Per (session, path): the latest edit, for ``keep_ms``; lets reads pass that no edit came so shortly before.

    Reads and edits wait until the watermark has passed them and are then taken in order of time, edits of the same instant first, so the
    result doesn't depend on micro-batches. State is one number for each key that was edited lately, and what is within the lateness.
    """

    def __init__(self, keep_ms: int):
        self.keep_us = keep_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.edited = handle.getValueState("edited", "us bigint")
        self.waiting = handle.getListState("waiting", "packed binary")  # 2 * microseconds, and one more for a read

    def _rows(self, key, micros: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({
            "session_id": pd.Series([key[0]] * len(micros), dtype="object"), "path": pd.Series([key[1]] * len(micros), dtype="object"),
            "ts": pd.to_datetime(pd.Series(micros, dtype="int64"), unit="us")})

    def _wake(self, micros: int, timerValues) -> None:
        self.handle.registerTimer(max(micros // 1000, timerValues.getCurrentWatermarkInMs()) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for part in rows:
            micros = part["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            if len(micros):
                self.waiting.appendList(_pack(2 * micros + part["is_read"].astype(bool).to_numpy()))
                least = int(micros.min()) if least is None else min(least, int(micros.min()))
        if least is not None:
            self._wake(least, timerValues)
        yield self._rows(key, np.empty(0, "int64"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        held = _unpack(self.waiting.get())
        due, rest = np.split(held, [np.searchsorted(held, 2 * limit + 1, "right")])
        edited = self.edited.get()[0] if self.edited.exists() else None
        us, is_read = due >> 1, (due & 1).astype(bool)
        last = np.maximum.accumulate(np.where(is_read, NEVER, us))
        last = np.where(last == NEVER, NEVER if edited is None else edited, last)
        passed = us[is_read & (last < us - self.keep_us)]
        if len(due) and last[-1] != NEVER:
            edited = int(last[-1])
        if len(rest):
            self.waiting.put(_pack(rest))
            self._wake(int(rest[0]) >> 1, timerValues)
        else:
            self.waiting.clear()
        if edited is not None and (len(rest) or limit <= edited + self.keep_us):
            self.edited.update((edited,))
            if not len(rest):
                self._wake(edited + self.keep_us, timerValues)
        else:
            self.edited.clear()
        yield self._rows(key, passed)

    def close(self) -> None:
        pass


def unedited_reads(reads: DataFrame, edits: DataFrame, keep_ms: int = KEEP_MS, late: str = "1 minute") -> DataFrame:
    """The read-after-edit guard on streams of (session_id, path, ts): a read is withheld if the latest edit of the same path and session
    before it, or at the same time, came at most ``keep_ms`` earlier.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    columns = ["session_id", "path", "ts"]
    both = reads.select(*columns, F.lit(True).alias("is_read")).union(edits.select(*columns, F.lit(False).alias("is_read")))
    return both.withWatermark("ts", late).groupBy("session_id", "path").transformWithStateInPandas(
        EditGuard(keep_ms), outputStructType="session_id string, path string, ts timestamp", outputMode="Append", timeMode="EventTime")
