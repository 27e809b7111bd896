"""Reports from partial aggregates against the reports over the events."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpuscope import schemas
from corpuscope.operators import rollups, usage
from corpuscope.sources.usage_log import UsageLog

TYPES = ["search", "search_savings", "index_substitute", "compression", "file_read", "turn_savings", "semantic_compression", "odd", None]


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        meta = rng.choice([None, "{", '{"query":"q%d"}' % rng.randint(0, 20), '{"path":"x"}'])
        ts = None if rng.random() < 0.03 else datetime(2023, 12, 1) + timedelta(seconds=rng.randint(0, 86400 * 62))
        rows.append((rng.choice(["a", "b", None]), i, rng.choice(TYPES), rng.choice([None, 0, 5, -3, 40]), 1, meta, ts))
    return spark.createDataFrame(rows, schemas.USAGE_EVENTS).cache()


@pytest.fixture(scope="module")
def log(spark, events, tmp_path_factory):
    out = UsageLog(spark, str(tmp_path_factory.mktemp("log")))
    for i in range(3):  # times of the batches interleave
        out.append(events.filter(f"id % 3 = {i}"), f"b{i}")
    out.append(events, "b1")  # committed before: nothing happens
    rollups.partials(events).withColumn("day", F.to_date("hour")).write.partitionBy("day").parquet(f"{out.root}/hours/batch=open")  # never committed
    return out


@pytest.mark.parametrize("period", ["year", "month", "week", "day", None])
@pytest.mark.parametrize("as_of", ["2024-01-31 00:00:00", "2024-01-20 13:37:11"])
def test_reports_are_equal(events, log, period, as_of):
    rows = log.partials(period, as_of)
    inside = usage.in_period(events, period, as_of)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert same(rollups.by_type(rows, "project_id"), usage.rollup_by_type(inside, "project_id"))
    assert same(rollups.timeline(rows, period, as_of), usage.timeline(events, period, as_of))
    assert same(rollups.top_queries(rows, 7), usage.top_queries(events, period, as_of, 7))
    assert same(rollups.global_totals(rows), usage.global_totals(events, period, as_of))


def test_a_period_reads_its_days_only(log, events):
    plan = log.partials("day", "2024-01-20 13:37:11")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [(") + plan.count("PartitionFilters: [isnotnull(day") + plan.count("PartitionFilters: [((day") >= 2
    assert log.events().count() == events.count() and log.partials("day", "2024-01-31 13:37:11").count() < 150


def test_an_empty_log(spark, tmp_path):
    log = UsageLog(spark, str(tmp_path / "log"))
    log.append(spark.createDataFrame([], schemas.USAGE_EVENTS))
    assert rollups.global_totals(log.partials("week", "2024-01-01 00:00:00")).first().total_events == 0
