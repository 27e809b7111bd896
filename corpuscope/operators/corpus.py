"""Which files belong to a corpus, and which projects there are."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from corpuscope import dims
from corpuscope.functions import columns as C
from corpuscope.operators.ranking import top_k_per_group


def has_code_extension(path: C.ColumnLike) -> Column:
    return C.extension(path).isin(*dims.CODE_EXTS)


def _components(path: C.ColumnLike) -> Column:
    return F.split(C.col(path), r"[/\\]", -1)


def in_ignored_dir(path: C.ColumnLike) -> Column:
    names = sorted({*dims.IGNORED_DIRS, *dims.GENERATED_DIRS})
    return F.arrays_overlap(_components(path), C.literal_array(names))


def is_generated(path: C.ColumnLike) -> Column:
    """In a generated directory, or named like a bundle."""
    return F.arrays_overlap(_components(path), C.literal_array(dims.GENERATED_DIRS)) | C.basename(
        path
    ).rlike(dims.GENERATED_NAME_RE)


def is_oversized(length: C.ColumnLike, max_bytes: int = dims.MAX_FILE_BYTES) -> Column:
    return C.col(length) > max_bytes


def is_sensitive(path: C.ColumnLike) -> Column:
    """Paths that must not reach any table; null and empty paths are not."""
    p = C.col(path)
    hit = p.rlike(dims.SENSITIVE_PATH_RES[0])
    for pattern in dims.SENSITIVE_PATH_RES[1:]:
        hit = hit | p.rlike(pattern)
    return F.coalesce(hit, F.lit(False))


def listing_filter(max_bytes: int = dims.MAX_FILE_BYTES) -> Column:
    """Files a corpus scan keeps; needs only path and length, so content is not read for others."""
    return (
        has_code_extension("file") & ~in_ignored_dir("file") & ~is_generated("file")
        & ~is_oversized("length", max_bytes)
    )


def read_corpus(
    spark: SparkSession, roots: dict[str, str], max_bytes: int = dims.MAX_FILE_BYTES
) -> DataFrame:
    """Source trees (project_id -> directory) as corpus rows.

    One scan lists all trees; it asks for path and length alone, so no content is opened there. Files that the filters
    keep are then read where their row is. A file below several roots belongs to each of their projects.
    """
    if not roots:
        return spark.createDataFrame([], "project_id STRING, file STRING, length BIGINT, content STRING")
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sorted(set(roots.values())))
        .select("path", "length").distinct().filter(F.col("length") <= max_bytes)
        .withColumn("file", F.regexp_replace("path", "^file:/*", "/")).filter(listing_filter(max_bytes))
    )
    named = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(re.sub("^file:/*", "/", r).rstrip("/") + "/").alias("r")) for p, r in roots.items()])
    owner = F.explode(F.filter(named, lambda x: F.col("file").startswith(x["r"])))
    return listed.withColumn("_content", _read_file("path")).select(owner.alias("o"), "file", "length", "_content").select(
        F.col("o.p").alias("project_id"), "file", "length", F.make_valid_utf8(F.col("_content").cast("string")).alias("content"),
    )


def read_listed(listing: DataFrame, max_bytes: int = dims.MAX_FILE_BYTES) -> DataFrame:
    """Corpus rows of a listing(project_id, file, length, ...), of ``sources.tree`` for one; only files that the filters keep are opened."""
    kept = listing.filter(listing_filter(max_bytes))
    content = F.make_valid_utf8(_read_file(F.when(F.col("file").startswith("/"), F.concat(F.lit("file:"), "file")).otherwise(F.col("file"))).cast("string"))
    return kept.select("project_id", "file", "length", content.alias("content"))


@F.pandas_udf(BinaryType())
def _read_file(paths: pd.Series) -> pd.Series:
    def content(uri: str) -> bytes:
        fs, path = pafs.FileSystem.from_uri(re.sub("^file:/*", "file:///", uri))
        with fs.open_input_stream(path, compression=None) as file:
            return file.read()

    return paths.map(content)


def scan_corpus(
    files: DataFrame, max_bytes: int = dims.MAX_FILE_BYTES, max_files: int | None = None
) -> DataFrame:
    """Kept files of a listing, capped per project in path order.

    The cap is off unless given (the interactive tool's is ``dims.MAX_FILES``, the first paths of a project); ``capped`` of
    ``corpus_summary`` tells where it would apply. Only paths travel
    through the ranking, and only those of projects over the cap; what comes out of it is the
    last kept path per such project, so contents are read once.
    """
    kept = files.filter(listing_filter(max_bytes))
    if max_files is None:
        return kept
    paths = kept.select("project_id", "file")
    over = paths.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_files)
    last = (
        top_k_per_group(
            paths.join(over.select("project_id"), "project_id", "left_semi"),
            ["project_id"], [F.asc("file")], max_files, salt_by=["file"],
        )
        .groupBy("project_id").agg(F.max("file").alias("_last"))
    )
    return kept.join(last, "project_id", "left").filter(
        F.col("_last").isNull() | (F.col("file") <= F.col("_last"))
    ).select(*files.columns)


def corpus_summary(files: DataFrame, max_files: int = dims.MAX_FILES) -> DataFrame:
    """Number of kept files per project and whether the cap was reached."""
    kept = files.filter(listing_filter())
    n = F.least(F.count(F.lit(1)), F.lit(max_files).cast("bigint"))
    return kept.groupBy("project_id").agg(
        n.alias("files"), (F.count(F.lit(1)) >= max_files).alias("capped")
    )


def project_roots(paths: DataFrame, parent: str, anchor: str | None = None, limit: int | None = None) -> DataFrame:
    """Directories under ``parent`` that hold a project marker, without the anchor itself.

    paths(path): any recursive listing. A directory counts through its direct entries only. ``limit`` keeps the first ones
    by path; ``dims.MAX_DISCOVERED`` is the interactive tool's.
    """
    prefix = parent.rstrip("/") + "/"
    rest = F.substr(F.col("path"), F.lit(len(prefix) + 1))
    parts = F.split(rest, "/", -1)
    entry = F.get(parts, F.lit(1))
    marker = entry.isin(*dims.PROJECT_MARKERS) | entry.rlike(dims.PROJECT_SUFFIX_RE)
    directory = F.get(parts, F.lit(0))
    roots = (
        paths.filter(F.col("path").startswith(prefix) & (F.size(parts) >= 2))
        .groupBy(directory.alias("name"))
        .agg(F.bool_or(F.coalesce(marker, F.lit(False))).alias("_is"))
        .filter(F.col("_is") & ~F.col("name").startswith(".") & ~F.col("name").isin(*dims.DISCOVERY_SKIP_DIRS))
        .select(F.concat(F.lit(prefix), "name").alias("path"))
    )
    if anchor:
        roots = roots.filter(F.col("path") != anchor.rstrip("/"))
    return roots if limit is None else roots.orderBy("path").limit(limit)


def files_of_roots(files: DataFrame, roots: DataFrame, parent: str) -> DataFrame:
    """Files of discovered projects, all projects in one job."""
    depth = len(parent.rstrip("/").split("/")) + 1
    root = F.array_join(F.slice(F.split("file", "/", -1), 1, depth), "/")
    named = roots.select(F.col("path").alias("_root"))
    return (
        files.withColumn("_root", root).join(named, "_root")
        .withColumn("project_id", C.project_id("_root")).drop("_root")
    )


def merge_projects(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """Registry upsert: new paths are added, known ones get the later ``last_seen``."""
    new = seen.select(
        C.project_id("path").alias("id"), "path", C.project_name("path").alias("name"), "last_seen",
        F.lit(0).cast("bigint").alias("chunks"), F.lit(0).cast("bigint").alias("files"),
    )
    both = registry.select(*new.columns, F.lit(0).alias("_new")).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy("path").agg(
        F.min_by("id", "_new").alias("id"), F.min_by("name", "_new").alias("name"),
        F.max("last_seen").alias("last_seen"), F.max("chunks").alias("chunks"), F.max("files").alias("files"),
    ).select(*new.columns)


def update_project_counts(registry: DataFrame, counts: DataFrame) -> DataFrame:
    c = counts.select(F.col("project_id").alias("id"), F.col("chunks").alias("_c"), F.col("files").alias("_f"))
    return registry.join(c, "id", "left").select(
        *[x for x in registry.columns if x not in ("chunks", "files")],
        F.coalesce("_c", "chunks").alias("chunks"), F.coalesce("_f", "files").alias("files"),
    )


def list_projects(registry: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Projects not under /tmp (and, if a listing is given, still there), latest first."""
    out = registry.filter(~F.col("path").rlike("^/tmp(/|$)"))
    if existing is not None:
        out = out.join(existing.select("path"), "path", "left_semi")
    return out.orderBy(F.desc("last_seen"), "id")


def get_project(registry: DataFrame, project: str) -> DataFrame:
    return list_projects(registry).filter(F.col("id") == project)
