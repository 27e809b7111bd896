"""Usage analytics over the append-only event log.

Inputs follow ``schemas.USAGE_EVENTS``. Every aggregate is a partial-then-final groupBy, so a
project, user or event type that owns a large share of the log is combined before the shuffle.
``as_of`` stands in for "now", so that results can be repeated.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope import dims
from corpuscope.functions import columns as C
from corpuscope.operators.ranking import running_total, top_k_per_group


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _as_of(as_of: datetime | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp")


def saved() -> Column:
    return F.coalesce(F.col("tokens_saved"), _zero())


def mechanism(event_type: C.ColumnLike) -> Column:
    """Savings mechanism of an event type; null for types that save nothing themselves."""
    table = F.create_map(*[F.lit(x) for kv in dims.MECHANISM_BY_EVENT.items() for x in kv])
    return F.try_element_at(table, C.col(event_type))


def period_spec(period: str | None) -> tuple[str, int, str]:
    return dims.PERIODS.get(period or "", dims.PERIODS[dims.DEFAULT_PERIOD])


def window_start(period: str | None, as_of: datetime | str) -> Column:
    unit, n, _ = period_spec(period)
    return F.timestamp_add(unit.upper(), F.lit(-n), _as_of(as_of))


def in_period(events: DataFrame, period: str | None, as_of: datetime | str) -> DataFrame:
    """Events inside the period's window; events without a time always count."""
    return events.filter((F.col("ts") > window_start(period, as_of)) | F.col("ts").isNull())


def append_events(
    rows: DataFrame, project: Column, event_type: Column, tokens_saved: Column,
    tokens_used: Column | None = None, meta: Column | None = None, ts: Column | None = None,
) -> DataFrame:
    """Shape rows as usage events: missing numbers become 0, ``meta`` a JSON text."""
    return rows.select(
        project.alias("project_id"),
        event_type.alias("event_type"),
        F.coalesce(tokens_saved.cast("bigint"), _zero()).alias("tokens_saved"),
        F.coalesce(tokens_used.cast("bigint") if tokens_used is not None else _zero(), _zero())
        .alias("tokens_used"),
        (F.to_json(meta) if meta is not None else F.lit(None).cast("string")).alias("meta"),
        (ts if ts is not None else F.current_timestamp()).alias("ts"),
    )


def rollup_by_type(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys, "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens_saved"), _zero()).alias("saved")
    )


def _count(event_type: str) -> Column:
    return F.count_if(F.col("event_type") == event_type)


def _sum(*event_types: str) -> Column:
    return F.coalesce(
        F.sum(F.when(F.col("event_type").isin(*event_types), F.col("tokens_saved"))), _zero()
    )


def usage_summary(events: DataFrame) -> DataFrame:
    """One summary row per project in a single conditional-aggregate pass."""
    base = events.groupBy("project_id").agg(
        _count("search").alias("searches"),
        _count("index_substitute").alias("index_substitutions"),
        _count("cache_hit").alias("cache_hits"),
        _count("file_read").alias("files_read"),
        _count("search_savings").alias("snippet_only"),
        _count("compression").alias("compactions"),
        _sum(*dims.SAVING_EVENTS).alias("measured_savings"),
        _sum("index_substitute").alias("index_substitution_saved"),
        _sum("semantic_compression").alias("semantic_compression_saved"),
        _sum("compression").alias("compression_saved"),
        _sum("search_savings").alias("search_snippets_saved"),
        _sum("generative_compression").alias("generative_compression_saved"),
        _sum("output_compression").alias("output_compression_saved"),
    )
    operations = F.col("files_read") + F.col("searches")
    intercepted = F.col("index_substitutions") + F.col("snippet_only")
    return (
        base.withColumn(
            "native_searches", F.greatest(_zero(), F.col("searches") - F.col("snippet_only"))
        )
        .withColumn(
            "efficiency_ratio",
            F.when(operations > 0, F.least(F.lit(1.0), intercepted / F.nullif(operations, _zero())))
            .otherwise(F.lit(0.0)),
        )
        .withColumn(
            "avg_saved_per_search",
            F.when(
                F.col("searches") > 0,
                F.floor(F.col("measured_savings") / F.nullif(F.col("searches"), _zero()) + 0.5),
            ).otherwise(_zero()),
        )
        .withColumn("status", F.when(F.col("searches") > 0, "active").otherwise("indexed"))
        .withColumn(
            "recommendations",
            F.when(F.col("searches") > 0, F.array().cast("array<string>")).otherwise(
                F.array(F.lit("Run some searches to track savings."))
            ),
        )
    )


def interception_rates(calls: DataFrame, *keys: str) -> DataFrame:
    """Share of classified tool calls that can be served from the index, per key."""
    hit = F.count_if(F.col("kind").isNotNull())
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        hit.alias("intercepted"),
        (hit / F.count(F.lit(1))).alias("rate"),
    )


def savings_by_mechanism(events: DataFrame, *keys: str) -> DataFrame:
    return (
        events.withColumn("mechanism", mechanism("event_type"))
        .filter(F.col("mechanism").isNotNull())
        .groupBy(*keys, "mechanism")
        .agg(F.sum(saved()).alias("saved"), F.count(F.lit(1)).alias("n"))
    )


def mechanism_share(by_mechanism: DataFrame) -> DataFrame:
    """Positive mechanisms with their share of the total (at most five input rows)."""
    total = F.sum("saved").over(Window.partitionBy(F.lit(1)))
    return (
        by_mechanism.withColumn("_total", total)
        .filter(F.col("saved") > 0)
        .select("mechanism", "saved", (F.col("saved") / F.col("_total")).alias("share"))
    )


def timeline(events: DataFrame, period: str | None, as_of: datetime | str) -> DataFrame:
    """Zero-filled buckets with counts and savings per mechanism.

    The bucket frame has at most 30 rows, so it is the broadcast side; events are reduced to
    one row per bucket before they meet it. Months are calendar months.
    """
    unit, n, fmt = period_spec(period)
    now = _as_of(as_of)
    first = F.date_trunc(unit, F.timestamp_add(unit.upper(), F.lit(-(n - 1)), now))
    frame = events.sparkSession.range(1).select(
        F.explode(
            F.sequence(first, F.date_trunc(unit, now), F.expr(f"interval 1 {unit}"))
        ).alias("bucket_ts")
    )
    grouped = (
        in_period(events, period, as_of)
        .withColumn("bucket_ts", F.date_trunc(unit, F.coalesce("ts", now)))
        .withColumn("_m", mechanism("event_type"))
        .groupBy("bucket_ts")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum(saved()).alias("saved"),
            *[F.sum(F.when(F.col("_m") == m, saved())).alias(m) for m in dims.MECHANISMS],
        )
    )
    return frame.join(grouped, "bucket_ts", "left").select(
        F.date_format("bucket_ts", fmt).alias("bucket"),
        *[
            F.coalesce(c, _zero()).alias(c)
            for c in ("count", "saved", *dims.MECHANISMS)
        ],
    )


def top_queries(events: DataFrame, period: str | None, as_of: datetime | str, k: int = 10) -> DataFrame:
    kind = F.col("event_type")
    return (
        in_period(events, period, as_of)
        .filter(kind.isin("search", "search_savings", "index_substitute"))
        .withColumn("query", C.json_text("meta", "query"))
        .filter(F.col("query").isNotNull())
        .groupBy("query")
        .agg(
            F.count_if(kind.isin("search", "index_substitute")).alias("count"),
            F.sum(F.when(kind != "search", saved()).otherwise(_zero())).alias("saved"),
        )
        .orderBy(F.desc("count"), "query")
        .limit(k)
    )


def global_totals(events: DataFrame, period: str | None, as_of: datetime | str) -> DataFrame:
    return in_period(events, period, as_of).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.coalesce(F.sum(saved()), _zero()).alias("total_saved_tokens"),
        _count("index_substitute").alias("index_substitutions"),
        _sum("index_substitute").alias("index_substitution_saved"),
        (_count("search") + _count("search_savings")).alias("search_substitutions"),
        _count("compression").alias("compressed_outputs"),
        _sum("compression").alias("compression_saved"),
        _count("file_read").alias("file_reads"),
        _sum("turn_savings").alias("turn_savings"),
    )


def cumulative_savings(
    events: DataFrame, period: str | None, as_of: datetime | str, keys: list[str] | None = None
) -> DataFrame:
    """Running total of positive savings in time order, cut to the period's buckets."""
    unit, n, _ = period_spec(period)
    positive = (
        in_period(events, period, as_of)
        .filter(F.col("tokens_saved") > 0)
        .select(
            *(keys or []), "id", F.coalesce("ts", _as_of(as_of)).alias("ts"), "tokens_saved"
        )
    )
    start = F.timestamp_add(unit.upper(), F.lit(-n), _as_of(as_of))
    return running_total(positive, ["ts", "id"], "tokens_saved", "total", keys).filter(
        F.col("ts") >= start
    )


def recent_events(events: DataFrame, k: int = 20, per_project: bool = False) -> DataFrame:
    if per_project:
        return top_k_per_group(events, ["project_id"], [F.desc("id")], k)
    return events.orderBy(F.desc("id")).limit(k)


def recent_activity(
    events: DataFrame, period: str | None, as_of: datetime | str, k: int = 20
) -> DataFrame:
    """Latest k events with what they were about."""
    return (
        in_period(events, period, as_of)
        .withColumn("ts", F.coalesce("ts", _as_of(as_of)))
        .orderBy(F.desc("ts"), F.desc("id"))
        .limit(k)
        .select(
            F.col("event_type").alias("type"),
            F.coalesce(
                C.json_text("meta", "path", "query", "key", "toolID", "symbol"), F.lit("—")
            ).alias("target"),
            saved().alias("tokens_saved"),
            "ts",
            F.col("project_id").alias("project"),
        )
    )


def turn_savings(interceptions: DataFrame) -> DataFrame:
    """Savings per session; sessions that saved nothing are dropped."""
    return (
        interceptions.groupBy("session_id")
        .agg(
            F.sum(saved()).alias("tokens_saved"),
            F.count(F.lit(1)).alias("tools_intercepted"),
            F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1000).alias("duration_ms"),
        )
        .filter(F.col("tokens_saved") != 0)
    )


def compaction_status(results: DataFrame) -> DataFrame:
    """Characters saved so far by summaries."""
    return results.agg(
        F.coalesce(
            F.sum(
                F.when(
                    F.col("method") == "semantic", F.col("original_len") - F.col("compressed_len")
                )
            ),
            _zero(),
        ).cast("bigint").alias("semantic_saved")
    ).withColumn("active", F.lit(True))


def active_project_totals(summary: DataFrame) -> DataFrame:
    active = (F.col("measured_savings") > 0) | (F.col("efficiency_ratio") > 0)
    return summary.filter(active).agg(
        F.count(F.lit(1)).alias("active_projects"),
        F.coalesce(F.sum("measured_savings"), _zero()).alias("total_savings"),
        F.coalesce(F.avg("efficiency_ratio"), F.lit(0.0)).alias("avg_efficiency"),
    )
