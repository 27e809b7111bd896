"""Top-k and prefix sums that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.session import cut_lineage

# Spark limits window groups before the shuffle only up to this k
# (spark.sql.optimizer.windowGroupLimitThreshold).
MAP_SIDE_LIMIT = 1000


def top_k_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    rank: str = "rank",
    salt_by: list[str] | None = None,
    salts: int = 64,
) -> DataFrame:
    """Exact top ``k`` per key, with its 1-based rank.

    For small k each map task forwards at most k rows per key, so a hot key costs its reducer
    tasks x k rows. For larger k Spark does not cut map-side; there a first cut runs per
    (key, salt), which spreads a hot key over ``salts`` tasks and stays exact.
    """
    if k > MAP_SIDE_LIMIT and salt_by:
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
            .withColumn("_cut", F.row_number().over(first))
            .filter(F.col("_cut") <= k)
            .drop("_salt", "_cut")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def running_total(
    df: DataFrame,
    order: list[str],
    value: str,
    total: str,
    keys: list[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order``, overall or per key.

    Distributed prefix sum: rows are range-partitioned on (keys, order), so neither a single
    global order nor one hot key or instant ends up in one task. The partition number is fixed
    by a reliable checkpoint, since both passes must see the same layout. Pass one sums per
    partition and key; pass two adds the sum of earlier partitions to a running sum inside the
    partition. ``order`` must be unique within a key.
    """
    keys = keys or []
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid_out = cut_lineage(
        df.repartitionByRange(n, *[F.col(c) for c in keys + order]).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    # At most one row per partition and key: n rows for a hot key.
    offsets = (
        laid_out.groupBy("_part", *keys)
        .agg(F.sum(value).alias("_sum"))
        .withColumn(
            "_offset",
            F.sum("_sum").over(before.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .drop("_sum")
    )
    within = (
        Window.partitionBy("_part", *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        laid_out.withColumn("_run", F.sum(value).over(within))
        .join(offsets, ["_part", *keys])
        .withColumn(total, F.col("_run") + F.coalesce("_offset", F.lit(0)))
        .drop("_part", "_run", "_offset")
    )
