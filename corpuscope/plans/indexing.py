"""Index jobs: full index of projects, discovery, incremental update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.operators import corpus, graph, incremental, index_stats, symbols
from corpuscope.session import cut_lineage
from corpuscope.sources.sinks import IndexStore

SCHEMA_VERSION = 3
#: Text of the sources whose symbols one task writes.
WRITTEN_TEXT = 4 << 20


def _meta(projects: DataFrame, ts) -> DataFrame:
    """lastIndexed, projectRoot and schema_version rows of each project(project_id, path)."""
    now = F.lit(ts).cast("timestamp") if ts is not None else F.current_timestamp()
    pairs = F.array(
        F.struct(F.lit("lastIndexed").alias("key"), F.date_format(now, "yyyy-MM-dd HH:mm:ss").alias("value")),
        F.struct(F.lit("projectRoot").alias("key"), F.col("path").alias("value")),
        F.struct(F.lit("schema_version").alias("key"), F.lit(str(SCHEMA_VERSION)).alias("value")),
    )
    return projects.select("project_id", F.explode(pairs).alias("m")).select("project_id", "m.*", now.alias("ts"))


def build_index(files: DataFrame, max_files: int | None = None) -> tuple[DataFrame, graph.EdgeTables, DataFrame]:
    """(chunks, edge tables, hashes) of a listing with contents, as one lazy lineage."""
    kept = corpus.scan_corpus(files, max_files=max_files)
    chunks = symbols.corpus_chunks(kept)
    return chunks, graph.EdgeTables.of(chunks, kept), incremental.hash_files(kept)


def _write_symbols(store: IndexStore, kept: DataFrame, run: str) -> None:
    """Chunks of the files, then references and imports of the written chunks: sources are parsed once. ``kept`` is read several times."""
    size = symbols.text_size(kept)
    tasks = max(1, size // WRITTEN_TEXT)
    store.write("chunks", symbols.corpus_chunks(kept, size), run, tasks)
    chunks = store.written("chunks", run)
    store.write("references", graph.references(chunks), run, tasks)
    store.write("imports", graph.import_references(chunks), run, tasks)
    store.index_words(run)


def index(
    store: IndexStore, files: DataFrame, projects: DataFrame, run: str | None = None, ts=None, max_files: int | None = None
) -> None:
    """Index whole projects.

    ``run`` is given to repeat a failed run under its id; a committed one isn't done again. The run closes all earlier ones of its
    projects: files that are gone leave the index. Other projects are not touched.
    """
    if run is None or not store.committed(run):
        run = store.begin(run)
        kept = cut_lineage(corpus.scan_corpus(files, max_files=max_files))
        _write_symbols(store, kept, run)
        store.write("files", incremental.hash_files(kept).withColumn("status", F.lit("add")), run)
        store.write("meta", _meta(projects, ts), run)
        store.commit(projects.select("project_id").union(store.written("files", run).select("project_id")), "full", run)


def analyze(
    store: IndexStore, files: DataFrame, projects: DataFrame, run: str | None = None, ts=None, max_files: int | None = None
) -> DataFrame:
    """``index`` whole projects and return the counts of all."""
    index(store, files, projects, run, ts, max_files)
    return index_stats.index_counts(store.chunks(), store.hashes(), store.edge_tables().counts())


def discover(store: IndexStore, listing: DataFrame, parent: str, anchor: str, run: str | None = None, ts=None,
             limit: int | None = None) -> DataFrame:
    """Find sibling projects of ``anchor`` and index them all in one job; ``limit`` keeps the first ones by path.

    listing(path, length, content): a recursive listing of ``parent``.
    """
    roots = corpus.project_roots(listing, parent, anchor, limit)
    files = corpus.files_of_roots(listing.withColumnRenamed("path", "file"), roots, parent)
    projects = roots.select(corpus.C.project_id("path").alias("project_id"), "path")
    return analyze(store, files, projects, run, ts)


def update(store: IndexStore, current: DataFrame, deleted: DataFrame | None, run: str | None = None) -> DataFrame:
    """Re-index the given files; unchanged ones are skipped, deleted ones leave the index.

    current(project_id, file, length, content) holds candidate files only, not the whole corpus; a candidate that no
    longer belongs to a corpus counts as deleted. Changes are found against committed runs; a retry under the same ``run`` does the
    same again, and nothing once the run is committed. Only the states of the given files are read; edges follow by themselves, as they
    are derived from references and definitions. Returns the (project_id, file, status) that were applied.
    """
    if run is None or not store.committed(run):
        run = store.begin(run)
        kept = current.filter(corpus.listing_filter())
        concerned = current.select("project_id", "file")
        if deleted is not None:
            concerned = concerned.unionByName(deleted.select("project_id", "file"))
        concerned = concerned.distinct()
        changes = incremental.detect_changes(incremental.hash_files(kept), store.hashes(concerned)).filter(
            F.col("status") != "unchanged"
        )
        store.write("files", changes, run)
        changes = store.written("files", run)
        touched = kept.join(changes.select("project_id", "file"), ["project_id", "file"], "left_semi")
        _write_symbols(store, cut_lineage(touched), run)
        store.commit(changes, "update", run)
    return store.written("files", run).select("project_id", "file", "status")
