"""One function per tool call of the engine, as batch jobs over tables.

``Workspace`` names the tables; each method returns DataFrames and collects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import columns as C
from corpuscope.operators import compaction, corpus, graph, index_stats, rendering, search, sessions, usage
from corpuscope.plans import indexing
from corpuscope.sources.sinks import IndexStore


@dataclass
class Workspace:
    store: IndexStore
    projects: DataFrame  # schemas.PROJECTS
    events: DataFrame  # schemas.USAGE_EVENTS

    def analyze(self, files: DataFrame, projects: DataFrame, run: str | None = None, ts=None) -> DataFrame:
        return indexing.analyze(self.store, files, projects, run, ts)

    def discover(self, listing: DataFrame, parent: str, anchor: str, run: str | None = None, ts=None, limit: int | None = None) -> DataFrame:
        return indexing.discover(self.store, listing, parent, anchor, run, ts, limit)

    def search(self, queries: DataFrame) -> DataFrame:
        """queries(query_id, project_id, q, n)."""
        return self.store.search(queries)

    def search_events(self, queries: DataFrame, results: DataFrame) -> DataFrame:
        """The usage event each search logs, with its number of hits."""
        hits = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
        rows = queries.join(hits, "query_id", "left")
        return usage.append_events(
            rows, F.col("project_id"), F.lit("search"), F.lit(0),
            meta=F.struct(F.col("q").alias("query"), F.coalesce("hits", F.lit(0)).alias("hits")),
        )

    def search_snippet(self, queries: DataFrame, root: Column) -> DataFrame:
        """queries(query_id, project_id, q, file_filter): compact pages of the top ten, and savings.

        The filter keeps files whose path holds it, which those equal to it or below it do; it applies before the ranking.
        """
        asked = queries.select("query_id", "project_id", "q", "file_filter", F.lit(search.dims.DEFAULT_RESULTS).alias("n"))
        found = self.store.search(asked, payload=("line_end", "lang", "body"), within="file_filter")
        pages = rendering.result_page(found, root, compact=True)
        return pages.join(queries.select("query_id", "project_id", "q"), "query_id").select(
            "query_id", "project_id",
            F.concat(F.lit('// index search: "'), "q", F.lit('"\n'), "text").alias("text"),
            C.estimate_tokens(F.length("q") * 10).alias("tokens_saved"),
        )

    def read_snippet(self, requests: DataFrame, root: Column, max_body_lines: int = 15) -> DataFrame:
        """requests(request_id, project_id, file, offset, limit)."""
        picked = search.chunks_in_range(self.store.chunks(), requests)
        return rendering.file_snippets(picked, ["request_id"], root, max_body_lines)

    def related(self, refs: DataFrame, root: Column) -> DataFrame:
        """refs(ref_id, project_id, ref): ``file:name`` references."""
        symbols = graph.parse_symbol_refs(refs, self.store.hashes(), root)
        return rendering.reference_text(self.store.edge_tables().related(symbols, ["ref_id"]), ["ref_id"])

    def impact(self, files: DataFrame) -> DataFrame:
        """files(project_id, file): dependents, rendered per project."""
        return rendering.reference_text(self.store.edge_tables().impacted(files), ["project_id"], impact=True)

    def compress_output(self, outputs: DataFrame, semantic: bool = True, **toggles: bool) -> tuple[DataFrame, DataFrame]:
        """(outputs with results, usage events of their projects). Tools that are not eligible pass through.

        outputs: schemas.TOOL_OUTPUTS with the project_id of the session.
        """
        eligible = compaction.compact(
            outputs.filter(compaction.is_compressible("tool_id")), semantic=semantic, **toggles
        )
        other = outputs.filter(~F.coalesce(compaction.is_compressible("tool_id"), F.lit(False))).select(
            "*", F.col("output").alias("compacted"), F.lit("none").alias("method"),
            F.length("output").alias("original_len"), F.length("output").alias("compressed_len"),
            F.lit(0).cast("bigint").alias("tokens_saved"),
        )
        return eligible.unionByName(other), compaction.compaction_events(eligible, F.col("project_id"), semantic)

    def compression(self, results: DataFrame) -> DataFrame:
        return usage.compaction_status(results)

    def stats(self) -> dict[str, DataFrame]:
        chunks = self.store.chunks()
        return {
            "counts": index_stats.index_counts(chunks, self.store.hashes(), self.store.edge_tables().counts()),
            "breakdown": index_stats.chunks_by_lang_and_type(chunks),
            "top_files": index_stats.top_files(chunks),
            "usage": usage.usage_summary(self.events),
            "savings": usage.savings_by_mechanism(self.events, "project_id"),
            "recent": usage.recent_events(self.events, per_project=True),
        }

    def aggregate(self) -> dict[str, DataFrame]:
        chunks = self.store.chunks()
        return {"breakdown": index_stats.chunks_by_lang_and_type(chunks), "top_files": index_stats.top_files(chunks)}

    def dashboard(self) -> DataFrame:
        return index_stats.dashboard(self.projects, self.store.hashes(), self.store.chunks(), self.events)

    def analytics(self, period: str, as_of) -> dict[str, DataFrame]:
        """The parts of one report; all but the index parts read the event log of the period only."""
        e, chunks = self.events, self.store.chunks()
        return {
            "timeline": usage.timeline(e, period, as_of),
            "cumulative": usage.cumulative_savings(e, period, as_of),
            "top_queries": usage.top_queries(e, period, as_of),
            "recent_activity": usage.recent_activity(e, period, as_of),
            "totals": usage.global_totals(e, period, as_of),
            "health": index_stats.index_health(self.projects, self.store.hashes(), chunks, self.store.meta()),
            "hot_files": index_stats.hot_files(chunks),
        }

    def projects_list(self) -> DataFrame:
        return corpus.list_projects(self.projects)

    def projects_get(self, project: str) -> DataFrame:
        return corpus.get_project(self.projects, project)

    def cache_report(self, calls: DataFrame, ttl_ms: int = 300_000) -> DataFrame:
        return sessions.reuse(calls, ttl_ms)
