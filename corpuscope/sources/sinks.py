"""Table sinks.

Index tables are logs: every run writes folders of its own, ``run=<id>``, and publishes them last, by one commit file with a
row for each of its projects. A commit takes the next place in the order of runs, so runs of different writers that take turns (a
stream and full runs, say) never share a folder or a place. Rows of a run without a commit are not seen, and a retried run replaces
its own folders until it is committed; after that it is left as it is. A full run closes everything before it for its projects; else
the latest run of a file counts. A change of a few files therefore never rewrites the whole table, and reads open the
folders of live runs only. ``fold`` makes these one. One run is open at a time.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope import schemas
from corpuscope.operators import graph, search
from corpuscope.operators.corpus import is_sensitive
from corpuscope.operators.postings import PostingIndex

STATE = "project_id STRING, file STRING, hash STRING, status STRING"


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of one key in one task, so that a partitioned write gives one file a key; adaptive execution splits keys of many rows
    and joins small ones."""
    return rows.sparkSession.sql(f"SELECT /*+ REBALANCE({', '.join(keys)}) */ * FROM {{rows}}", rows=rows)


class IndexStore:
    """Chunks, references, imports and file states of an index under one folder."""

    TABLES = {
        "chunks": schemas.CHUNKS, "references": schemas.REFERENCES, "imports": schemas.IMPORTS, "files": STATE,
        "meta": schemas.META, "commits": schemas.COMMITS,
    }

    def __init__(self, spark: SparkSession, root: str, searchable: bool = False):
        """``searchable``: every run keeps postings of its chunks, and ``search`` reads these."""
        self.spark, self.root, self.searchable = spark, root, searchable
        self._live_of: tuple[list[str], list[str]] | None = None

    @property
    def postings(self) -> PostingIndex:
        return PostingIndex(self.spark, f"{self.root}/postings")

    def _path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def _columns(self, name: str) -> list[str]:
        return [c.strip().split(" ")[0] for c in self.TABLES[name].split(",")]

    def begin(self, run: str | None = None) -> str:
        """Id of the run that is about to write; a fresh one if none is given to repeat. A committed run can't begin again."""
        if run is not None and self.committed(run):
            raise ValueError(f"run {run} is committed")
        return run or uuid.uuid4().hex

    def write(self, name: str, rows: DataFrame, run: str, tasks: int = 1) -> None:
        """Idempotent: a retried run replaces its own folder. ``tasks``: how many share the rows of a project, by file; adaptive execution would
        leave them to one up to its size of a partition, and so those who read the one file."""
        chosen = rows.select(*self._columns(name))
        file = next((c for c in ("file", "source_file") if c in chosen.columns), None)
        if tasks > 1 and file:
            placed = chosen.repartition(tasks, "project_id", file)
        else:
            placed = dealt(chosen, "project_id")
        placed.write.mode("overwrite").partitionBy("project_id").parquet(f"{self._path(name)}/run={run}")

    def index_words(self, run: str) -> None:
        """Keep postings of the chunks that the run has written."""
        if self.searchable:
            self.postings.add(self.written("chunks", run), run)

    def commit(self, projects: DataFrame, kind: str, run: str) -> None:
        """Publish what the run has written for projects(project_id); kind is full or update."""
        self.begin(run)
        place = (self.log("commits").agg(F.max("seq")).first()[0] or 0) + 1
        rows = projects.select("project_id", F.lit(kind).alias("kind"), F.lit(place).cast("bigint").alias("seq")).distinct()
        rows.coalesce(1).write.mode("error").parquet(f"{self._path('commits')}/run={run}")

    def _exists(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def log(self, name: str, runs: list[str] | None = None) -> DataFrame:
        """All rows ever written to a table, or those of ``runs``, whose folders alone are listed and opened."""
        schema, path = self.TABLES[name] + ", run STRING", self._path(name)
        folders = [f for f in ([path] if runs is None else [f"{path}/run={r}" for r in runs]) if self._exists(f)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(*folders)

    def committed(self, run: str) -> bool:
        return not self.log("commits", [run]).isEmpty()

    def written(self, name: str, run: str) -> DataFrame:
        """What one run wrote, committed or not."""
        return self.log(name, [run]).drop("run")

    def live(self) -> DataFrame:
        """(project_id, run, seq) of the runs since the last full one of each project."""
        commits = self.log("commits")
        full = commits.groupBy("project_id").agg(F.max(F.when(F.col("kind") == "full", F.col("seq"))).alias("_full"))
        open_ = commits.join(full, "project_id").filter(F.col("_full").isNull() | (F.col("seq") >= F.col("_full")))
        return open_.select("project_id", "run", "seq")

    def _commit_files(self) -> list[str]:
        """Files of the commits that are done; each commit adds one and none changes."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path('commits')}/run=*/*.parquet")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(f.getPath().toString() for f in found or [])

    def _live_runs(self) -> list[str]:
        """Ids of the live runs, which ``fold`` keeps few; found again when there is a new commit, whoever wrote it."""
        files = self._commit_files()
        if self._live_of is None or self._live_of[0] != files:
            self._live_of = files, [r.run for r in self.live().select("run").distinct().collect()]
        return self._live_of[1]

    def _of_live(self, name: str) -> DataFrame:
        """Rows in folders of live runs."""
        return self.log(name, self._live_runs())

    def published(self, name: str) -> DataFrame:
        """Log rows of live runs with the place ``seq`` of their run."""
        return self._of_live(name).join(self.live(), ["project_id", "run"])

    def states(self, concerned: DataFrame | None = None) -> DataFrame:
        """Latest state per file, with the run that wrote it; of ``concerned`` (project_id, file) only, if given."""
        rows = self.published("files")
        if concerned is not None:
            rows = rows.join(concerned, ["project_id", "file"], "left_semi")
        latest = F.max_by(F.struct("hash", "status", "run"), "seq").alias("s")
        return rows.groupBy("project_id", "file").agg(latest).select("project_id", "file", "s.*")

    def hashes(self, concerned: DataFrame | None = None) -> DataFrame:
        return self.states(concerned).filter(F.col("status") != "delete").select("project_id", "file", "hash")

    def _current(self, name: str, file_column: str) -> DataFrame:
        live = self.states().filter(F.col("status") != "delete").select(
            "project_id", F.col("file").alias(file_column), "run"
        )
        return self._of_live(name).join(live, ["project_id", file_column, "run"], "left_semi").drop("run")

    def chunks(self) -> DataFrame:
        return self._current("chunks", "file")

    def edge_tables(self) -> graph.EdgeTables:
        """References and imports as stored, with the definitions of the current chunks: no edge can go stale."""
        return graph.EdgeTables(
            self._current("references", "source_file"), graph.definitions(self.chunks()),
            self._current("imports", "source_file"), self.hashes(),
        )

    def edges(self) -> DataFrame:
        return self.edge_tables().expand()

    def meta(self) -> DataFrame:
        latest = F.max_by(F.struct("value", "ts"), F.struct("ts", "seq")).alias("v")
        return self.published("meta").groupBy("project_id", "key").agg(latest).select("project_id", "key", "v.*")

    def search(self, queries: DataFrame, **options) -> DataFrame:
        """``search.search`` over the current chunks, by their postings if the store keeps them."""
        if not self.searchable:
            return search.search(self.chunks(), queries, **options)
        live = self.states().filter(F.col("status") != "delete").select("project_id", "file", F.col("run").alias("segment"))
        return self.postings.search(queries, live=live, segments=self._live_runs(), **options)

    def _copy(self, target: IndexStore, run: str) -> None:
        """Write the current state as one full run of ``target``."""
        target.write("chunks", self.chunks(), run)
        target.index_words(run)
        target.write("references", self._current("references", "source_file"), run)
        target.write("imports", self._current("imports", "source_file"), run)
        target.write("files", self.states().filter(F.col("status") != "delete"), run)
        target.write("meta", self.meta(), run)
        target.commit(self.log("commits"), "full", run)

    def fold(self) -> str:
        """Make the live runs one full run, in place; readers see the same rows before and after its commit."""
        run = self.begin()
        self._copy(self, run)
        return run

    def compact(self, target: IndexStore) -> None:
        """Write the current state as one full run of another store."""
        self._copy(target, target.begin())


def append_usage(events: DataFrame, path: str) -> None:
    """Append usage events, laid out by day; ``read_usage`` prunes by it. Events without a time have the null day."""
    dealt(events.withColumn("day", F.to_date("ts")), "day").write.mode("append").partitionBy("day").parquet(path)


def read_usage(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """Usage events later than ``since`` (all if not given); those without a time always count, as in ``usage.in_period``.

    The scan reads the days of the span and the null day only.
    """
    rows = spark.read.schema(schemas.USAGE_EVENTS + ", day DATE").parquet(path)
    if since is not None:
        rows = rows.filter((F.col("day") >= F.to_date(since)) | F.col("day").isNull())
        rows = rows.filter((F.col("ts") > since) | F.col("ts").isNull())
    return rows.drop("day")


def append_audit(substitutions: DataFrame, path: str) -> None:
    """One JSON line per substitution; sensitive paths never reach it."""
    substitutions.filter(~is_sensitive("path")).write.mode("append").json(path)


def audit_rows(substituted: DataFrame, tool: str = "tool_id", path: str | None = None) -> DataFrame:
    return substituted.filter("substituted").select(
        "ts", "session_id", F.col(tool).alias("tool_name"),
        (F.col(path) if path else F.lit(None).cast("string")).alias("path"),
        F.length("output").cast("bigint").alias("original_chars"),
        F.length("result").cast("bigint").alias("substitute_chars"),
    )
