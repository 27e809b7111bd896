"""Counts, rankings and health of indexed projects.

Chunk tables are reduced to one row per (project, file) first; everything else works on that.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.operators.ranking import top_k_per_group


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def chunks_per_file(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("project_id", "file").agg(F.count(F.lit(1)).alias("n"))


def index_counts(chunks: DataFrame, file_hashes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Chunks, files and edges per project."""
    parts = [
        chunks.select("project_id", F.lit(1).alias("c"), F.lit(0).alias("f"), _zero().alias("e")),
        file_hashes.select("project_id", F.lit(0).alias("c"), F.lit(1).alias("f"), _zero().alias("e")),
    ]
    if edges is not None:
        parts.append(edges.select("project_id", F.lit(0).alias("c"), F.lit(0).alias("f"), F.col("n").alias("e")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("project_id").agg(
        F.sum("c").alias("chunks"), F.sum("f").alias("files"), F.sum("e").alias("edges")
    )


def chunks_by_lang_and_type(chunks: DataFrame) -> DataFrame:
    """Both breakdowns from one scan."""
    return (
        chunks.groupingSets([["lang"], ["type"]], "lang", "type")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("lang").alias("_no_lang"))
        .select(
            F.when(F.col("_no_lang") == 0, "lang").otherwise("type").alias("dimension"),
            F.when(F.col("_no_lang") == 0, F.col("lang")).otherwise(F.col("type")).alias("value"),
            "n",
        )
    )


def chunks_by_extension(chunks: DataFrame) -> DataFrame:
    ext = F.concat(F.lit("."), F.element_at(F.split("file", r"\.", -1), -1))
    return chunks.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def top_files(chunks: DataFrame, k: int = 10) -> DataFrame:
    return (
        chunks.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file").limit(k)
    )


def hot_files(chunks: DataFrame, per_project: int = 5, k: int = 10) -> DataFrame:
    """Each project's largest files, one row per path (the larger project wins), then the top k."""
    leaders = top_k_per_group(
        chunks_per_file(chunks), ["project_id"], [F.desc("n"), F.asc("file")], per_project
    )
    best = F.max_by("project_id", F.struct(F.col("n"), F.col("project_id")))
    return (
        leaders.groupBy(F.col("file").alias("path"))
        .agg(F.max("n").alias("count"), best.alias("project"))
        .orderBy(F.desc("count"), "path")
        .limit(k)
    )


def fan_in(edges: DataFrame, k: int = 10) -> DataFrame:
    """Files referenced from the most other files."""
    return (
        edges.select("project_id", "target_file", "source_file").distinct()
        .groupBy("project_id", "target_file").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "project_id", "target_file").limit(k)
    )


def index_health(
    projects: DataFrame, file_hashes: DataFrame, chunks: DataFrame, meta: DataFrame
) -> DataFrame:
    """Chunk and file counts, files without chunks, and last index time per project.

    Hashed files meet chunk files in one union-and-group on (project, file): each file is two
    partial rows at most, so no join is needed and a large project spreads by file.
    """
    per_file = (
        file_hashes.select("project_id", "file", F.lit(1).alias("h"), F.lit(0).alias("c"))
        .unionByName(chunks.select("project_id", "file", F.lit(0).alias("h"), F.lit(1).alias("c")))
        .groupBy("project_id", "file")
        .agg(F.max("h").alias("hashed"), F.sum("c").alias("n"))
    )
    counts = per_file.groupBy("project_id").agg(
        F.sum("n").alias("chunks"),
        F.sum("hashed").cast("bigint").alias("files"),
        F.count_if((F.col("hashed") == 1) & (F.col("n") == 0)).alias("zero_chunk_files"),
    )
    indexed = meta.filter(F.col("key") == "lastIndexed").select(
        "project_id", F.col("value").alias("last_indexed")
    )
    out = (
        projects.select(F.col("id").alias("project_id"), "name", "path")
        .join(counts, "project_id", "left")
        .join(indexed, "project_id", "left")
    )
    return out.select(
        "project_id", "name", "path", "last_indexed",
        *[F.coalesce(c, _zero()).alias(c) for c in ("chunks", "files", "zero_chunk_files")],
    )


def freshness(health: DataFrame, as_of: datetime | str) -> DataFrame:
    """Age score of the last index and share of files that have chunks."""
    age = (
        F.unix_micros(F.lit(str(as_of)).cast("timestamp"))
        - F.unix_micros(F.col("last_indexed").cast("timestamp"))
    ) / 3_600_000_000
    indexed = F.greatest(_zero(), F.col("files") - F.col("zero_chunk_files"))
    return health.select(
        "project_id",
        F.when(age < 1, 1.0).when(age < 24, 0.8).when(age < 168, 0.5).otherwise(0.2).alias("freshness"),
        indexed.alias("indexed_files"),
        F.when(F.col("files") > 0, indexed / F.nullif(F.col("files"), _zero()))
        .otherwise(0.0).alias("indexed_ratio"),
    )


def dashboard(projects: DataFrame, file_hashes: DataFrame, chunks: DataFrame, events: DataFrame) -> DataFrame:
    """One row of totals over registered projects."""
    ids = projects.select(F.col("id").alias("project_id"))
    parts = (
        (chunks, F.lit(1), F.lit(0), _zero(), F.lit(0)),
        (file_hashes, F.lit(0), F.lit(1), _zero(), F.lit(0)),
        (events, F.lit(0), F.lit(0), F.coalesce(F.col("tokens_saved"), _zero()), F.lit(1)),
    )
    rows = None
    for df, c, f, s, e in parts:
        part = df.groupBy("project_id").agg(
            F.sum(c).alias("c"), F.sum(f).alias("f"), F.sum(s).alias("s"), F.sum(e).alias("e")
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(ids, "project_id", "left_semi").agg(
        F.coalesce(F.sum("c"), _zero()).alias("total_chunks"),
        F.coalesce(F.sum("f"), _zero()).alias("total_files"),
        F.coalesce(F.sum("s"), _zero()).alias("total_saved_tokens"),
        F.coalesce(F.sum("e"), _zero()).alias("total_events"),
    )


def enrich_projects(projects: DataFrame, counts: DataFrame, summary: DataFrame, k: int = 5) -> DataFrame:
    """The k most recently seen projects with their counts and savings."""
    top = projects.orderBy(F.desc("last_seen"), "id").limit(k)
    stats = counts.select("project_id", "chunks", "files", "edges")
    usage = summary.select("project_id", "measured_savings", "searches", "efficiency_ratio")
    joined = (
        top.select(F.col("id").alias("project_id"), "name", "last_seen")
        .join(stats, "project_id", "left").join(usage, "project_id", "left")
    )
    return joined.select(
        "project_id", "name",
        *[F.coalesce(c, _zero()).alias(c) for c in ("chunks", "files", "edges", "measured_savings", "searches")],
        F.coalesce("efficiency_ratio", F.lit(0.0)).alias("efficiency_ratio"),
    )


def recent_index_events(changes: DataFrame, k: int = 20) -> DataFrame:
    return changes.orderBy(F.desc("ts"), F.desc("file")).limit(k)
