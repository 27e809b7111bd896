"""Usage-event streams: live totals and turn savings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope import schemas
from corpuscope.operators.usage import mechanism, saved


def read_usage(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schemas.USAGE_EVENTS).option("maxFilesPerTrigger", max_files).parquet(folder)


def live_timeline(events: DataFrame, bucket: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and savings per tumbling window and mechanism; combined before the shuffle."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", bucket), F.coalesce(mechanism("event_type"), F.lit("none")).alias("mechanism"))
        .agg(F.count(F.lit(1)).alias("count"), F.sum(saved()).alias("saved"))
        .select(F.col("window.start").alias("bucket_ts"), "mechanism", "count", "saved")
    )


def turns(interceptions: DataFrame, idle: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """Savings per session turn, closed after ``idle``; turns that saved nothing drop out.

    interceptions(session_id, tokens_saved, ts). Streaming form of ``operators.usage.turn_savings``.
    """
    return (
        interceptions.withWatermark("ts", late)
        .groupBy("session_id", F.session_window("ts", idle).alias("turn"))
        .agg(
            F.sum(saved()).alias("tokens_saved"), F.count(F.lit(1)).alias("tools_intercepted"),
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        )
        .filter(F.col("tokens_saved") != 0)
        .select(
            "session_id", "tokens_saved", "tools_intercepted",
            F.floor((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1000).alias("duration_ms"),
        )
    )
