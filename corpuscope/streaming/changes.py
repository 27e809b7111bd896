"""File-change stream: filters, per-file settling, and incremental re-indexing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope import schemas
from corpuscope.operators.corpus import in_ignored_dir, is_generated
from corpuscope.plans.indexing import update
from corpuscope.sources.sinks import IndexStore

SETTLE = "500 milliseconds"


def read_changes(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Change log as a stream: JSON rows of schemas.FILE_CHANGES."""
    return (
        spark.readStream.schema(schemas.FILE_CHANGES).option("maxFilesPerTrigger", max_files).json(folder)
        .filter(~in_ignored_dir("file") & ~is_generated("file"))
    )


def deletions(changes: DataFrame) -> DataFrame:
    """Deletes take effect at once."""
    return changes.filter(F.col("action") == "delete").select("project_id", "file", "action", "ts")


def settled(changes: DataFrame, quiet: str = SETTLE, late: str = "10 seconds") -> DataFrame:
    """One row per burst of changes of a file, once it has been quiet; the last action wins.

    State is one session per file that is being edited; the watermark drops it afterwards.
    """
    return (
        changes.filter(F.col("action") != "delete")
        .withWatermark("ts", late)
        .groupBy("project_id", "file", F.session_window("ts", quiet))
        .agg(F.max_by("action", "ts").alias("action"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("events"))
        .select("project_id", "file", "action", "ts", "events")
    )


def index_batches(
    store: IndexStore, load_files: Callable[[DataFrame], DataFrame], stream: str | None = None
) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler that re-indexes the files of a batch.

    ``load_files`` maps (project_id, file) to corpus rows of the files that exist. A batch is a run of its own, named after the
    stream and the batch number, so a retried batch replaces itself or, once committed, does nothing, and runs of other
    writers in between stay what they are. ``stream`` is by default the id of the streaming query, which its checkpoint keeps.
    """

    def handle(batch: DataFrame, number: int) -> None:
        name = stream or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not name:
            raise ValueError("outside a streaming query the handler needs the name of the stream")
        if batch.isEmpty():
            return
        keys = batch.select("project_id", "file").distinct()
        files = load_files(keys)
        # A file that is gone by now counts as deleted.
        gone = keys.join(files.select("project_id", "file"), ["project_id", "file"], "left_anti")
        update(store, files, gone, f"{name}-{number}")

    return handle
