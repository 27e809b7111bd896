"""Streams run over file sources to the end of what is there (availableNow)."""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuscope import schemas
from corpuscope.operators import sessions
from corpuscope.sources.sinks import IndexStore
from corpuscope.streaming import changes, loops, usage

T0 = datetime(2024, 1, 1)


def _drain(stream, name, tmp_path, mode="append"):
    q = (
        stream.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    return stream.sparkSession.sql(f"select * from {name}").collect()


def _change_file(folder, n, rows):
    folder.mkdir(exist_ok=True)
    with open(folder / f"{n}.json", "w") as f:
        for file, action, ms in rows:
            f.write(json.dumps({
                "project_id": "p", "file": file, "action": action,
                "ts": (T0 + timedelta(milliseconds=ms)).isoformat(),
            }) + "\n")


def test_changes_settle_and_deletes_pass(spark, tmp_path):
    folder = tmp_path / "in"
    _change_file(folder, 1, [
        ("/a.ts", "add", 0), ("/a.ts", "change", 300), ("/a.ts", "change", 700), ("/a.ts", "change", 5000),
        ("/b.ts", "delete", 100), ("/node_modules/c.ts", "change", 100), ("/x.min.js", "change", 100),
    ])
    _change_file(folder, 2, [("/z.ts", "add", 60_000)])
    stream = changes.read_changes(spark, str(folder), 1)
    got = {(r.file, r.action, r.events) for r in _drain(changes.settled(stream), "settled", tmp_path)}
    assert {("/a.ts", "change", 3), ("/a.ts", "change", 1)} <= got
    assert not any(f in ("/node_modules/c.ts", "/x.min.js", "/b.ts") for f, _, _ in got)
    gone = _drain(changes.deletions(stream), "gone", tmp_path)
    assert [r.file for r in gone] == ["/b.ts"]


def test_stream_updates_index(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    disk = {
        "/a.ts": "export function one() {\n  two()\n}\n",
        "/b.ts": "export function two() {\n  return 2\n}\n",
    }

    def load(keys):
        rows = [("p", f, len(c), c) for f, c in disk.items()]
        return spark.createDataFrame(rows, schemas.CORPUS).join(keys, ["project_id", "file"], "left_semi")

    folder = tmp_path / "in"
    _change_file(folder, 1, [("/a.ts", "add", 0), ("/b.ts", "add", 0)])
    stream = changes.read_changes(spark, str(folder), 1)

    def run():
        q = (
            stream.writeStream.foreachBatch(changes.index_batches(store, load))
            .option("checkpointLocation", str(tmp_path / "ck_index")).trigger(availableNow=True).start()
        )
        q.awaitTermination(180)
        assert q.exception() is None

    run()
    assert {r.name for r in store.chunks().filter("type = 'function'").collect()} == {"one", "two"}
    assert [(r.source_symbol, r.target_symbol) for r in store.edges().filter("kind = 'call' and source_symbol='one'")
            .select("source_symbol", "target_symbol").distinct().collect()] == [("one", "two")]
    disk["/a.ts"] = "export function one() {\n}\nfunction more() {\n}\n"
    del disk["/b.ts"]
    _change_file(folder, 2, [("/a.ts", "change", 1000), ("/b.ts", "delete", 1000)])
    run()
    assert {r.name for r in store.chunks().filter("type = 'function'").collect()} == {"one", "more"}
    assert store.edges().count() == 0
    assert {r.file for r in store.hashes().collect()} == {"/a.ts"}


def test_live_timeline_and_turns(spark, tmp_path):
    rows = [("p", i, "compression" if i % 2 else "search", 10, 0, None, T0 + timedelta(minutes=20 * i)) for i in range(12)]
    spark.createDataFrame(rows, schemas.USAGE_EVENTS).coalesce(1).write.parquet(str(tmp_path / "ev"))
    events = usage.read_usage(spark, str(tmp_path / "ev"))
    live = _drain(usage.live_timeline(events), "live", tmp_path, "update")
    assert sum(r["count"] for r in live) == 12
    assert {r["saved"] for r in live if r["mechanism"] == "compression"} == {10, 20}


def test_turns_close_after_idle(spark, tmp_path):
    rows = [("p", i, "compression", 10, 0, None, T0 + timedelta(minutes=m)) for i, m in enumerate((0, 2, 4, 30, 31))]
    late = [("p", 99, "compression", 0, 0, None, T0 + timedelta(hours=9))]
    spark.createDataFrame(rows, schemas.USAGE_EVENTS).coalesce(1).write.parquet(str(tmp_path / "ev"))
    spark.createDataFrame(late, schemas.USAGE_EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    events = usage.read_usage(spark, str(tmp_path / "ev"), 1).withColumn("session_id", F.lit("s"))
    out = _drain(usage.turns(events), "turns2", tmp_path)
    assert sorted((r.tokens_saved, r.tools_intercepted, r.duration_ms) for r in out) == [(20, 2, 60_000), (30, 3, 240_000)]


@pytest.mark.parametrize("files", [1, 100])
def test_live_loops_match_batch(spark, tmp_path, files):
    """One file a trigger or all at once: reads that arrive late, but inside the watermark, are numbered by their time."""
    schema = "session_id string, path string, ts timestamp"
    parts = [
        [("s", "/a.ts", 60), ("t", "/a.ts", 60)], [("s", "/a.ts", 20)], [("s", "/a.ts", 130), ("s", "/b.ts", 140), ("s", "/a.ts", 90)],
        [("s", "/a.ts", 400)], [("s", "/a.ts", 480)], [("end", "/", 90 * 3600)],
    ]
    for rows in parts:
        frame = spark.createDataFrame([(a, b, T0 + timedelta(seconds=t)) for a, b, t in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "reads"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "reads"))
    live = {(r.session_id, r.path, r.ts, r["count"], r.looping) for r in _drain(loops.live_loops(stream), f"loops{files}", tmp_path)}
    batch = spark.read.parquet(str(tmp_path / "reads")).where("session_id <> 'end'").withColumn("id", F.monotonically_increasing_id())
    assert live == {(r.session_id, r.path, r.ts, r["count"], r.looping) for r in sessions.detect_loops(batch).collect()}
    assert sorted(c for s, p, _, c, _ in live if (s, p) == ("s", "/a.ts")) == [1, 1, 1, 2, 3, 4]


@pytest.mark.parametrize("files", [1, 100])
def test_guard_keeps_the_latest_edit(spark, tmp_path, files):
    """Edits at 00:00 and 23:00: a read at 01:00 of the next day comes two hours after an edit. The state is freed a day after the last one."""
    hour = lambda h: T0 + timedelta(hours=h)
    schema = "session_id string, path string, ts timestamp"
    edits = [[("s", "/a", hour(0))], [("s", "/a", hour(23))], [("s", "/late", hour(30))], [("z", "/q", hour(300))]]
    reads = [[("s", "/a", hour(-1)), ("s", "/a", hour(0)), ("t", "/a", hour(1))], [("s", "/a", hour(25)), ("s", "/b", hour(25))],
             [("s", "/a", hour(47)), ("s", "/late", hour(30)), ("s", "/a", hour(47.1))], [("s", "/a", hour(100)), ("z", "/z", hour(300))]]
    for name, parts in (("edits", edits), ("reads", reads)):
        for rows in parts:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    streams = [spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / n)) for n in ("reads", "edits")]
    out = [(r.session_id, r.path, (r.ts - T0).total_seconds() / 3600) for r in _drain(loops.unedited_reads(*streams), f"guard{files}", tmp_path)]
    assert sorted(out) == [("s", "/a", -1), ("s", "/a", 47.1), ("s", "/a", 100), ("s", "/b", 25), ("t", "/a", 1)]


class _Held:
    """A state variable of one key, kept in memory."""

    def __init__(self):
        self.value, self.entries = None, []

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(self.entries) if self.value is None else self.value

    def update(self, value):
        self.value = value

    def appendList(self, entries):  # noqa: N802
        self.entries += entries

    def put(self, entries):
        self.entries = list(entries)

    def clear(self):
        self.value, self.entries = None, []


def test_waiting_reads_are_packed():
    """Reads of a key wait in few entries of state, not in one each; they count as they do one by one."""
    for keep in (None, 400_000):
        counter = loops.ReadCounter(keep_ms=keep)
        counter.handle = SimpleNamespace(registerTimer=lambda ms: None)
        counter.state, counter.waiting = _Held(), _Held()
        micros = [(i * 7919) % 100_003 * 20_000 for i in range(100_003)]
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
        list(counter.handleInputRows(("s", "f"), iter([pd.DataFrame({"ts": pd.to_datetime(pd.Series(micros), unit="us")})]), times))
        assert len(counter.waiting.entries) == 2
        got = []
        for mark in (700_000, 900_000, 3_000_000):
            times = SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark)
            got += pd.concat(counter.handleExpiredTimer(("s", "f"), times, None))["count"].tolist()
        first, seen, want = None, 0, []
        for us in sorted(micros):
            if first is None or (keep is not None and us // 1000 - first >= keep):
                first, seen = us // 1000, 0
            near = us // 1000 - first < loops.WINDOW_MS
            seen += near
            want.append(seen if near else 1)
        assert got == want
