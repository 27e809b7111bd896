"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names; default the headline list).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

from corpuscope.operators import index_stats
from corpuscope.queries import usage as usage_queries
from corpuscope.queries.registry import registered
from corpuscope.session import build_session

HEADLINE = (
    "a6_usage_summary", "a9_timeline_month", "a11_top_queries", "w1_cumulative_savings",
    "w1_cumulative_by_project", "j1_index_health", "w4_hot_files", "a2_chunks_by_lang_and_type",
    "c2_collapse_runs", "c7_compact_structural", "c11_compact_semantic",
    "q8_search_ranked", "q8_search_benchmark_batch", "q8_search_stored", "q11_file_snippets", "q13_result_pages",
    "x_symbol_chunks", "x21_html_chunks", "x24_markdown_headings", "g1_g4_edges", "g10_related_text",
    "d1_d2_changes", "d3_replace_by_file", "s1_corpus_scan", "p1_classify_calls", "w6_loop_detection",
    "w7_conversation_terms", "j8_reuse",
)


def health_of_copies(spark, folder: str, copies: int = 2):
    """J1 over several copies of all projects, files and chunks: at sf0.1 two of them are 191,000 chunks."""
    def times(df, *names: str):
        out = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        return out.withColumns({n: F.concat_ws("-", n, "_copy") for n in names}).drop("_copy")

    return index_stats.index_health(
        times(usage_queries.T.projects(spark, folder), "id", "path"), times(usage_queries.T.file_hashes(spark, folder), "project_id"),
        times(usage_queries._files_with_chunks(spark, folder), "project_id"), times(usage_queries._meta(spark, folder), "project_id"),
    )


EXTRA = {"j1_index_health_copies": health_of_copies}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        "bench", master=f"local[{cpus}]",
        **{"spark.checkpoint.dir": os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="spark-"), "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # session start is not a query
    table = registered()
    seconds: dict[str, float] = {}
    for name in names.split(",") if names else (*HEADLINE, *EXTRA):
        start = time.perf_counter()
        run = EXTRA[name] if name in EXTRA else table[name][0]
        run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
