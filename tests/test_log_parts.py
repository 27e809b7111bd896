"""Logs in parts against compaction of the whole text."""

from __future__ import annotations

import random

import pytest

from corpuscope.operators import compaction, log_parts

LINES = ["same", "same", "same", "other", "", "", "    at frame (x.js:1:2)", "\x1b[31mred\x1b[0m", "x" * 70, "a (x3)"]
SHAPE = ["log_id", "compacted", "method", "original_len", "compressed_len", "tokens_saved"]


def logs():
    rng = random.Random(3)
    out = []
    for i in range(120):
        lines = []
        for _ in range(rng.choice([0, 1, 2, 4, 30, 400])):
            lines += [rng.choice(LINES)] * rng.choice([1, 1, 2, 3, 9])
        out.append((f"l{i}", rng.choice(["bash", "grep", "read", "zzz"]), "\n".join(lines)))
    out.append(("long", "bash", "\n".join(["tick"] * 2500 + [f"line {i // 3}" for i in range(6000)] + ["tock"] * 500)))
    out.append(("zero", "bash", "\n".join(["", "", "", "abcdefg", "abcdefg", "q"] + ["k"] * 3)))
    return out


@pytest.mark.parametrize("size", [1, 4, 50])
def test_parts_give_the_result_of_the_whole(spark, size):
    rng = random.Random(size)
    parts = []
    for log, tool, text in logs():
        lines, at, number = text.split("\n"), 0, 0
        while at < len(lines):
            step = rng.randint(1, 2 * size) if log != "long" else 9  # the long log has 1,000 parts
            parts.append((log, tool, number, "\n".join(lines[at:at + step])))
            at, number = at + step, number + 1
    rng.shuffle(parts)
    assert sum(p[0] == "long" for p in parts) == 1000
    whole = spark.createDataFrame(logs(), "log_id string, tool_id string, output string")
    want = sorted(map(tuple, compaction.compact(whole).select(*SHAPE).collect()))
    got = log_parts.compact_parts(spark.createDataFrame(parts, "log_id string, tool_id string, part long, text string"))
    assert sorted(map(tuple, got.select(*SHAPE).collect())) == want


def test_a_run_through_many_parts_is_one(spark):
    parts = [("a", "bash", i, "x\nx") for i in range(50)] + [("a", "bash", 50, "x\ny"), ("b", "bash", 0, None), ("c", "bash", 0, "x")]
    frame = spark.createDataFrame(parts, "log_id string, tool_id string, part long, text string")
    got = {r.log_id: r.compacted for r in log_parts.compact_parts(frame).collect()}
    assert got == {"a": "x (x101)\ny", "c": "x"}
    assert log_parts.compact_parts(frame.limit(0)).count() == 0
