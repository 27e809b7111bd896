"""Usage analytics from partial aggregates.

``partials`` folds events to one row per project, hour, event type and query, with a count and the saved tokens. Such rows can be
merged, and every unit of the periods is at least an hour, so period reports need no other rows but the events of the hour in which the
period begins. Results are those of the functions of ``usage`` on the events.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope import dims
from corpuscope.functions import columns as C
from corpuscope.operators import usage as U

COLUMNS = "project_id STRING, hour TIMESTAMP, event_type STRING, query STRING, n BIGINT, saved BIGINT"
#: Event types whose queries are ranked.
ASKING = ("search", "search_savings", "index_substitute")


def partials(events: DataFrame) -> DataFrame:
    """(project_id, hour, event_type, query, n, saved); events without a time have the null hour."""
    query = F.when(F.col("event_type").isin(*ASKING), C.json_text("meta", "query"))
    return events.groupBy("project_id", F.date_trunc("hour", "ts").alias("hour"), "event_type", query.alias("query")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(U.saved()).cast("bigint").alias("saved"))


def _sum(value: str, *event_types: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("event_type").isin(*event_types), F.col(value))), U._zero())


def by_type(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "event_type").agg(F.sum("n").alias("n"), F.sum("saved").alias("saved"))


def timeline(rows: DataFrame, period: str | None, as_of: datetime | str) -> DataFrame:
    """Zero-filled buckets with counts and savings per mechanism."""
    unit, n, fmt = U.period_spec(period)
    now = U._as_of(as_of)
    first = F.date_trunc(unit, F.timestamp_add(unit.upper(), F.lit(-(n - 1)), now))
    frame = rows.sparkSession.range(1).select(
        F.explode(F.sequence(first, F.date_trunc(unit, now), F.expr(f"interval 1 {unit}"))).alias("bucket_ts"))
    grouped = rows.withColumn("_m", U.mechanism("event_type")).groupBy(F.date_trunc(unit, F.coalesce("hour", now)).alias("bucket_ts")).agg(
        F.sum("n").alias("count"), F.sum("saved").alias("saved"),
        *[F.sum(F.when(F.col("_m") == m, F.col("saved"))).alias(m) for m in dims.MECHANISMS])
    return frame.join(grouped, "bucket_ts", "left").select(
        F.date_format("bucket_ts", fmt).alias("bucket"), *[F.coalesce(c, U._zero()).alias(c) for c in ("count", "saved", *dims.MECHANISMS)])


def top_queries(rows: DataFrame, k: int = 10) -> DataFrame:
    return rows.filter(F.col("query").isNotNull()).groupBy("query").agg(
        _sum("n", "search", "index_substitute").alias("count"), _sum("saved", "search_savings", "index_substitute").alias("saved"),
    ).orderBy(F.desc("count"), "query").limit(k)


def global_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.coalesce(F.sum("n"), U._zero()).alias("total_events"),
        F.coalesce(F.sum("saved"), U._zero()).alias("total_saved_tokens"),
        _sum("n", "index_substitute").alias("index_substitutions"),
        _sum("saved", "index_substitute").alias("index_substitution_saved"),
        _sum("n", "search", "search_savings").alias("search_substitutions"),
        _sum("n", "compression").alias("compressed_outputs"),
        _sum("saved", "compression").alias("compression_saved"),
        _sum("n", "file_read").alias("file_reads"),
        _sum("saved", "turn_savings").alias("turn_savings"),
    )
