"""Incremental maintenance: change detection and replace-by-file on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE = ["project_id", "file"]


def hash_files(files: DataFrame) -> DataFrame:
    return files.select(*FILE, F.sha2("content", 256).alias("hash"))


def detect_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """status add / change / delete / unchanged per file, by content hash.

    One grouping over both snapshots of hashes: file keys are unique, and contents stay put.
    """
    both = current.select(*FILE, F.col("hash").alias("_new"), F.lit(None).cast("string").alias("_old")).unionByName(
        previous.select(*FILE, F.lit(None).cast("string").alias("_new"), F.col("hash").alias("_old"))
    )
    merged = both.groupBy(*FILE).agg(F.max("_new").alias("hash"), F.max("_old").alias("old_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "add").when(F.col("hash").isNull(), "delete")
        .when(F.col("hash") != F.col("old_hash"), "change").otherwise("unchanged")
    )
    return merged.select(*FILE, status.alias("status"), "hash")


def touched(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("status") != "unchanged").select(*FILE)


def replace_by_file(old: DataFrame, new: DataFrame, changed: DataFrame, file_column: str = "file") -> DataFrame:
    """Rows of changed (or deleted) files give way to the new ones."""
    keys = changed.select("project_id", F.col("file").alias(file_column)).distinct()
    return old.join(keys, ["project_id", file_column], "left_anti").unionByName(new)


def replace_outbound_edges(edges: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    return replace_by_file(edges, new, changed, "source_file")


def prune_indexed(indexed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Indexed files that still have chunks."""
    return indexed.join(chunks.select(*FILE).distinct(), FILE, "left_semi")


def upsert(table: DataFrame, updates: DataFrame, keys: list[str], order: str = "ts") -> DataFrame:
    """Latest row per key wins; a tie goes to the update.

    ``max_by`` combines before the shuffle, so a key that is written often costs no more.
    """
    values = [c for c in table.columns if c not in keys]
    both = table.withColumn("_pri", F.lit(0)).unionByName(updates.select(*table.columns).withColumn("_pri", F.lit(1)))
    latest = F.max_by(F.struct(*values), F.struct(F.col(order), F.col("_pri"))).alias("_v")
    return both.groupBy(*keys).agg(latest).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values]).select(
        *table.columns
    )


def meta_value(meta: DataFrame, key: str) -> DataFrame:
    return meta.filter(F.col("key") == key).select("project_id", "value")


def schema_version(meta: DataFrame) -> DataFrame:
    """Stored schema version per project; 0 for anything but a non-negative number."""
    n = F.regexp_extract("value", r"^\s*(\d{1,9})", 1).try_cast("int")
    return meta_value(meta, "schema_version").select("project_id", F.coalesce(n, F.lit(0)).alias("version"))
