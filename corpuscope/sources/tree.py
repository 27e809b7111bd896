"""Source trees as a data source: a partitioned listing, and its changes as a stream.

``spark.read.format("source_tree")`` lists the files of ``roots`` (JSON, project_id -> directory), one task for each directory
directly below a root and one for the root's own files; ignored directories are not entered. ``spark.readStream`` gives add,
change and delete rows. An offset names a snapshot: one file for each of these directories, written by the task that lists it, in the
folder ``snapshots`` that all executors share. A batch that is repeated finds its snapshot and gives the same rows.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from corpuscope import dims

LISTING = "project_id STRING, file STRING, length BIGINT, mtime_ms BIGINT"
CHANGES = "project_id STRING, file STRING, action STRING, length BIGINT, ts TIMESTAMP"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/*", "file:///", uri) if ":" in uri else f"file://{uri}")


def _entries(fs: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    return sorted(fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)), key=lambda e: e.path)


def walk(fs: pafs.FileSystem, path: str, deep: bool = True) -> Iterator[tuple[str, int, int]]:
    """(path, length, mtime_ms) of the files below a directory, or directly in it."""
    open_ = [path]
    while open_:
        for entry in _entries(fs, open_.pop()):
            if entry.type == pafs.FileType.File:
                yield entry.path, entry.size, int((entry.mtime_ns or 0) // 1_000_000)
            elif entry.type == pafs.FileType.Directory and deep and entry.base_name not in dims.IGNORED_DIRS:
                open_.append(entry.path)


@dataclass
class Part(InputPartition):
    """A directory of a project; ``deep`` with all below it. ``start`` and ``end``: snapshots of a stream."""

    project_id: str
    uri: str
    deep: bool
    start: int = 0
    end: int = 0

    def key(self) -> str:
        return sha256(f"{self.project_id}\n{self.uri}\n{self.deep}".encode()).hexdigest()[:32]


def _parts(roots: dict[str, str]) -> list[Part]:
    out = []
    for project, root in sorted(roots.items()):
        fs, path = _filesystem(root)
        out.append(Part(project, root, False))
        for e in _entries(fs, path):
            if e.type == pafs.FileType.Directory and e.base_name not in dims.IGNORED_DIRS:
                out.append(Part(project, f"{root.rstrip('/')}/{e.base_name}", True))
    return out


class ListingReader(DataSourceReader):
    def __init__(self, roots: dict[str, str]):
        self.roots = roots

    def partitions(self) -> list[Part]:
        return _parts(self.roots) or [Part("", "", False)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.uri:
            fs, path = _filesystem(partition.uri)
            for file, length, mtime in walk(fs, path, partition.deep):
                yield partition.project_id, file, length, mtime


class ChangeReader(DataSourceStreamReader):
    """Offsets are {"snapshot": milliseconds}; 0 is the empty tree."""

    def __init__(self, roots: dict[str, str], folder: str):
        self.roots, self.folder = roots, folder.rstrip("/")

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        now = int(time.time() * 1000)
        self._write(f"{now}/directories", [(p.project_id, p.uri, p.deep) for p in _parts(self.roots)])
        return {"snapshot": now}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        named = {tuple(p) for n in (start["snapshot"], end["snapshot"]) for p in self._read(f"{n}/directories") or []}
        return [Part(*p, start["snapshot"], end["snapshot"]) for p in sorted(named)]

    def read(self, partition: Part) -> Iterator[tuple]:
        from datetime import datetime, timezone

        name = partition.key()
        before = {f: (length, mtime) for f, length, mtime in self._read(f"{partition.start}/{name}") or []}
        held = self._read(f"{partition.end}/{name}")
        if held is None:  # else the batch is repeated
            fs, path = _filesystem(partition.uri)
            held = [list(x) for x in walk(fs, path, partition.deep)]
            self._write(f"{partition.end}/{name}", held)
        seen = set()
        for file, length, mtime in held:
            seen.add(file)
            old = before.get(file)
            if old != (length, mtime):
                yield partition.project_id, file, "add" if old is None else "change", length, datetime.fromtimestamp(mtime / 1000, timezone.utc)
        gone = datetime.fromtimestamp(partition.end / 1000, timezone.utc)
        for file in sorted(set(before) - seen):
            yield partition.project_id, file, "delete", None, gone

    def commit(self, end: dict) -> None:
        """Snapshots before the committed one are not needed any more."""
        fs, path = _filesystem(self.folder)
        for e in _entries(fs, path):
            if e.type == pafs.FileType.Directory and e.base_name.isdigit() and int(e.base_name) < end["snapshot"]:
                fs.delete_dir(e.path)

    def _read(self, name: str) -> list | None:
        fs, path = _filesystem(f"{self.folder}/{name}.json")
        if fs.get_file_info(path).type != pafs.FileType.File:
            return None
        with fs.open_input_stream(path) as f:
            return [json.loads(line) for line in f.read().decode().splitlines()]

    def _write(self, name: str, rows: list) -> None:
        """Whole files only: written aside and moved."""
        fs, path = _filesystem(f"{self.folder}/{name}.json")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        aside = f"{path}.{time.time_ns()}"
        with fs.open_output_stream(aside) as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        fs.move(aside, path)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def _roots(self) -> dict[str, str]:
        return json.loads(self.options.get("roots", "{}"))

    def schema(self) -> str:
        return CHANGES if self.options.get("changes", "false") == "true" else LISTING

    def reader(self, schema) -> ListingReader:
        return ListingReader(self._roots())

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self._roots(), self.options["snapshots"])


def list_tree(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(project_id, file, length, mtime_ms) of all files of the trees."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("roots", json.dumps(roots)).load()


def tree_changes(spark: SparkSession, roots: dict[str, str], snapshots: str) -> DataFrame:
    """Stream of (project_id, file, action, length, ts): what has come, changed or gone since the snapshot before."""
    spark.dataSource.register(SourceTree)
    return (
        spark.readStream.format("source_tree").option("roots", json.dumps(roots)).option("snapshots", snapshots).option("changes", "true").load()
    )


def write_tree(files: DataFrame, base: str) -> int:
    """Write files(file, content) below ``base``, one task its own rows; a null content removes the file. Their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(base)
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                path = root + file
                if content is None:
                    fs.delete_file(path)
                    continue
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(path) as f:
                    f.write(content.encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return files.select("file", "content").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
