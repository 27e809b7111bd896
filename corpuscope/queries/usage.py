"""Registered usage-analytics queries and their SQL equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuscope import dims
from corpuscope.operators import index_stats, rollups, usage
from corpuscope.session import ensure_checkpoint_dir
from corpuscope.sources import tables as T
from corpuscope.sources.sinks import append_usage, read_usage
from corpuscope.sources.usage_log import UsageLog

AS_OF = T.AS_OF
NOW = f"TIMESTAMP '{AS_OF}'"
STEP = {"year": ("month", 12), "month": ("day", 30), "week": ("day", 7), "day": ("hour", 24)}


def _in_period(period: str) -> str:
    unit, n = STEP[period]
    return f"(ts > {NOW} - INTERVAL {n} {unit} OR ts IS NULL)"


MECH_SQL = """CASE WHEN event_type IN ('index_substitute','file_read') THEN 'indexSubstitution'
 WHEN event_type = 'search_savings' THEN 'searchSnippets' WHEN event_type = 'compression' THEN 'compression'
 WHEN event_type = 'semantic_compression' THEN 'semanticCompression' WHEN event_type = 'cache_hit' THEN 'cacheHit' END"""

SAVING_LIST = ", ".join(f"'{t}'" for t in dims.SAVING_EVENTS)

SUMMARY_CTE = f"""
summary AS (
  SELECT *, greatest(0, searches - snippet_only) AS native_searches,
    CASE WHEN files_read + searches > 0
      THEN least(1.0, (index_substitutions + snippet_only) / CAST(files_read + searches AS DOUBLE)) ELSE 0.0 END
      AS efficiency_ratio,
    CASE WHEN searches > 0 THEN CAST(floor(measured_savings / CAST(searches AS DOUBLE) + 0.5) AS BIGINT) ELSE 0 END
      AS avg_saved_per_search,
    CASE WHEN searches > 0 THEN 'active' ELSE 'indexed' END AS status
  FROM (SELECT project_id,
    count(*) FILTER (event_type = 'search') AS searches,
    count(*) FILTER (event_type = 'index_substitute') AS index_substitutions,
    count(*) FILTER (event_type = 'cache_hit') AS cache_hits,
    count(*) FILTER (event_type = 'file_read') AS files_read,
    count(*) FILTER (event_type = 'search_savings') AS snippet_only,
    count(*) FILTER (event_type = 'compression') AS compactions,
    CAST(coalesce(sum(tokens_saved) FILTER (event_type IN ({SAVING_LIST})), 0) AS BIGINT) AS measured_savings,
    CAST(coalesce(sum(tokens_saved) FILTER (event_type = 'semantic_compression'), 0) AS BIGINT)
      AS semantic_compression_saved
    FROM usage GROUP BY project_id))
"""
SUMMARY_COLS = (
    "project_id", "searches", "native_searches", "index_substitutions", "cache_hits", "files_read",
    "snippet_only", "compactions", "measured_savings", "semantic_compression_saved",
    "efficiency_ratio", "avg_saved_per_search", "status",
)


def _summary(spark, folder):
    out = usage.usage_summary(T.usage_events(spark, folder)).select(*SUMMARY_COLS)
    return out.withColumn("efficiency_ratio", F.round("efficiency_ratio", 6))


def _share(spark, folder):
    by = usage.savings_by_mechanism(T.usage_events(spark, folder))
    return usage.mechanism_share(by).withColumn("share", F.round("share", 6))


def _timeline(period):
    return lambda s, d: usage.timeline(T.usage_events(s, d), period, AS_OF)


def _timeline_sql(period):
    unit, n = STEP[period]
    fmt = {"month": "%Y-%m", "day": "%Y-%m-%d", "hour": "%Y-%m-%dT%H"}[unit]
    mechs = ", ".join(
        f"CAST(coalesce(sum(tokens_saved) FILTER (m = '{m}'), 0) AS BIGINT) AS \"{m}\"" for m in dims.MECHANISMS
    )
    return f"""WITH {T.USAGE_SQL},
frame AS (SELECT unnest(generate_series(date_trunc('{unit}', {NOW} - INTERVAL {n - 1} {unit}),
   date_trunc('{unit}', {NOW}), INTERVAL 1 {unit})) AS b),
e AS (SELECT *, date_trunc('{unit}', coalesce(ts, {NOW})) AS b, {MECH_SQL} AS m FROM usage WHERE {_in_period(period)})
SELECT strftime(frame.b, '{fmt}') AS bucket, count(e.id) AS count,
  CAST(coalesce(sum(tokens_saved), 0) AS BIGINT) AS saved, {mechs}
FROM frame LEFT JOIN e ON e.b = frame.b GROUP BY frame.b"""


def _micros(df, name="ts"):
    return df.withColumn(name, F.unix_micros(name))


def _files_with_chunks(spark, folder):
    """Chunks as an index holds them: only files with a known language have any."""
    chunks = T.text_chunks(spark, folder)
    return chunks.filter(F.col("lang").isin(*set(dims.LANG_BY_EXT.values())))


LANG_LIST = ", ".join(f"'{v}'" for v in sorted(set(dims.LANG_BY_EXT.values())))
INDEX_CTES = f"""{T.CHUNKS_SQL}, indexed AS (SELECT * FROM chunks WHERE lang IN ({LANG_LIST}))"""


def _meta(spark, folder):
    return T.projects(spark, folder).select(
        F.col("id").alias("project_id"), F.lit("lastIndexed").alias("key"),
        F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("value"),
    )


def _health(spark, folder):
    return index_stats.index_health(
        T.projects(spark, folder), T.file_hashes(spark, folder),
        _files_with_chunks(spark, folder), _meta(spark, folder),
    )


HEALTH_CTES = f"""{T.PROJECTS_SQL}, {INDEX_CTES},
health AS (
  SELECT p.id AS project_id, p.name, p.path, strftime(p.last_seen, '%Y-%m-%d %H:%M:%S') AS last_indexed,
    coalesce(c.n, 0) AS chunks, coalesce(f.n, 0) AS files, coalesce(z.n, 0) AS zero_chunk_files
  FROM projects p
  LEFT JOIN (SELECT project_id, count(*) AS n FROM indexed GROUP BY 1) c ON c.project_id = p.id
  LEFT JOIN (SELECT project_id, count(*) AS n FROM files GROUP BY 1) f ON f.project_id = p.id
  LEFT JOIN (SELECT project_id, count(*) AS n FROM files ff
             WHERE NOT EXISTS (SELECT 1 FROM indexed i WHERE i.project_id = ff.project_id AND i.file = ff.file)
             GROUP BY 1) z ON z.project_id = p.id)"""


def _freshness(spark, folder):
    out = index_stats.freshness(_health(spark, folder), AS_OF)
    return out.withColumn("indexed_ratio", F.round("indexed_ratio", 6))


def _changes(spark, folder):
    ev = T.table(spark, folder, "events")
    return ev.select(
        F.concat(F.lit("src/f"), F.get_json_object("props", "$.k"), F.lit(".ts")).alias("file"),
        F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "add")
        .otherwise("change").alias("action"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


LOG_SINCE = "2024-01-15 12:00:00"


def _usage_log(spark, folder):
    """The event log appended in two parts and read back for a span."""
    path = f"{ensure_checkpoint_dir(spark)}/usage-{uuid.uuid4().hex}"
    events = T.usage_events(spark, folder)
    append_usage(events.filter("id % 2 = 0"), path)
    append_usage(events.filter("id % 2 = 1"), path)
    out = read_usage(spark, path, F.lit(LOG_SINCE).cast("timestamp"))
    return out.select("project_id", "id", "event_type", "tokens_saved", "tokens_used", F.unix_micros("ts").alias("ts"))


_LOGS: dict[tuple[str, str], UsageLog] = {}


def usage_log(spark, folder) -> UsageLog:
    """The event log in three batches of interleaved times, kept for all reports of an application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _LOGS:
        log = UsageLog(spark, f"{ensure_checkpoint_dir(spark)}/log-{uuid.uuid4().hex}")
        for i in range(3):
            log.append(T.usage_events(spark, folder).filter(f"id % 3 = {i}"))
        _LOGS[key] = log
    return _LOGS[key]


def _rolled_timeline(period):
    return lambda s, d: rollups.timeline(usage_log(s, d).partials(period, AS_OF), period, AS_OF)


QUERIES = {
    "s13_usage_log": (
        _usage_log,
        f"""WITH {T.USAGE_SQL} SELECT project_id, id, event_type, tokens_saved, tokens_used, epoch_us(ts) AS ts FROM usage
        WHERE ts IS NULL OR ts > TIMESTAMP '{LOG_SINCE}'""",
    ),
    "a5_event_rollup": (
        lambda s, d: usage.rollup_by_type(T.usage_events(s, d)),
        f"""WITH {T.USAGE_SQL} SELECT event_type, count(*) AS n,
        CAST(coalesce(sum(tokens_saved), 0) AS BIGINT) AS saved FROM usage GROUP BY 1""",
    ),
    "a6_usage_summary": (
        _summary,
        f"""WITH {T.USAGE_SQL}, {SUMMARY_CTE}
        SELECT project_id, searches, native_searches, index_substitutions, cache_hits, files_read, snippet_only,
          compactions, measured_savings, semantic_compression_saved,
          round(efficiency_ratio, 6) AS efficiency_ratio, avg_saved_per_search, status FROM summary""",
    ),
    "a7_savings_by_mechanism": (
        lambda s, d: usage.savings_by_mechanism(T.usage_events(s, d), "project_id"),
        f"""WITH {T.USAGE_SQL} SELECT project_id, {MECH_SQL} AS mechanism, CAST(sum(tokens_saved) AS BIGINT) AS saved,
        count(*) AS n FROM usage WHERE {MECH_SQL} IS NOT NULL GROUP BY 1, 2""",
    ),
    "a8_mechanism_share": (
        _share,
        f"""WITH {T.USAGE_SQL}, m AS (SELECT {MECH_SQL} AS mechanism, CAST(sum(tokens_saved) AS BIGINT) AS saved
        FROM usage WHERE {MECH_SQL} IS NOT NULL GROUP BY 1)
        SELECT mechanism, saved, round(saved / CAST((SELECT sum(saved) FROM m) AS DOUBLE), 6) AS share
        FROM m WHERE saved > 0""",
    ),
    **{
        f"a9_timeline_{p}": (_timeline(p), _timeline_sql(p)) for p in ("year", "month", "week", "day")
    },
    "a10_period_filter": (
        lambda s, d: usage.rollup_by_type(usage.in_period(T.usage_events(s, d), "week", AS_OF), "project_id"),
        f"""WITH {T.USAGE_SQL} SELECT project_id, event_type, count(*) AS n, CAST(sum(tokens_saved) AS BIGINT) AS saved
        FROM usage WHERE {_in_period('week')} GROUP BY 1, 2""",
    ),
    "a11_top_queries": (
        lambda s, d: usage.top_queries(T.usage_events(s, d), "month", AS_OF),
        f"""WITH {T.USAGE_SQL} SELECT m_query AS query,
        count(*) FILTER (event_type IN ('search', 'index_substitute')) AS count,
        CAST(sum(CASE WHEN event_type <> 'search' THEN tokens_saved ELSE 0 END) AS BIGINT) AS saved
        FROM usage WHERE {_in_period('month')} AND m_query IS NOT NULL
        AND event_type IN ('search', 'search_savings', 'index_substitute')
        GROUP BY 1 ORDER BY count DESC, query LIMIT 10""",
    ),
    "a12_global_totals": (
        lambda s, d: usage.global_totals(T.usage_events(s, d), "month", AS_OF),
        f"""WITH {T.USAGE_SQL}, e AS (SELECT * FROM usage WHERE {_in_period('month')})
        SELECT count(*) AS total_events, CAST(sum(tokens_saved) AS BIGINT) AS total_saved_tokens,
        count(*) FILTER (event_type = 'index_substitute') AS index_substitutions,
        CAST(sum(tokens_saved) FILTER (event_type = 'index_substitute') AS BIGINT) AS index_substitution_saved,
        count(*) FILTER (event_type IN ('search', 'search_savings')) AS search_substitutions,
        count(*) FILTER (event_type = 'compression') AS compressed_outputs,
        CAST(sum(tokens_saved) FILTER (event_type = 'compression') AS BIGINT) AS compression_saved,
        count(*) FILTER (event_type = 'file_read') AS file_reads,
        CAST(sum(tokens_saved) FILTER (event_type = 'turn_savings') AS BIGINT) AS turn_savings FROM e""",
    ),
    **{
        f"a9_rollup_timeline_{p}": (_rolled_timeline(p), _timeline_sql(p)) for p in ("year", "month", "week", "day")
    },
    "a10_rollup_period": (
        lambda s, d: rollups.by_type(usage_log(s, d).partials("week", AS_OF), "project_id"),
        f"""WITH {T.USAGE_SQL} SELECT project_id, event_type, count(*) AS n, CAST(sum(tokens_saved) AS BIGINT) AS saved
        FROM usage WHERE {_in_period('week')} GROUP BY 1, 2""",
    ),
    "a11_rollup_queries": (
        lambda s, d: rollups.top_queries(usage_log(s, d).partials("month", AS_OF)),
        f"""WITH {T.USAGE_SQL} SELECT m_query AS query,
        count(*) FILTER (event_type IN ('search', 'index_substitute')) AS count,
        CAST(sum(CASE WHEN event_type <> 'search' THEN tokens_saved ELSE 0 END) AS BIGINT) AS saved
        FROM usage WHERE {_in_period('month')} AND m_query IS NOT NULL
        AND event_type IN ('search', 'search_savings', 'index_substitute')
        GROUP BY 1 ORDER BY count DESC, query LIMIT 10""",
    ),
    "a12_rollup_totals": (
        lambda s, d: rollups.global_totals(usage_log(s, d).partials("month", AS_OF)),
        f"""WITH {T.USAGE_SQL}, e AS (SELECT * FROM usage WHERE {_in_period('month')})
        SELECT count(*) AS total_events, CAST(sum(tokens_saved) AS BIGINT) AS total_saved_tokens,
        count(*) FILTER (event_type = 'index_substitute') AS index_substitutions,
        CAST(sum(tokens_saved) FILTER (event_type = 'index_substitute') AS BIGINT) AS index_substitution_saved,
        count(*) FILTER (event_type IN ('search', 'search_savings')) AS search_substitutions,
        count(*) FILTER (event_type = 'compression') AS compressed_outputs,
        CAST(sum(tokens_saved) FILTER (event_type = 'compression') AS BIGINT) AS compression_saved,
        count(*) FILTER (event_type = 'file_read') AS file_reads,
        CAST(sum(tokens_saved) FILTER (event_type = 'turn_savings') AS BIGINT) AS turn_savings FROM e""",
    ),
    "a13_dashboard": (
        lambda s, d: index_stats.dashboard(
            T.projects(s, d), T.file_hashes(s, d), _files_with_chunks(s, d), T.usage_events(s, d)
        ),
        f"""WITH {T.USAGE_SQL}, {T.PROJECTS_SQL}, {INDEX_CTES}
        SELECT (SELECT count(*) FROM indexed WHERE project_id IN (SELECT id FROM projects)) AS total_chunks,
        (SELECT count(*) FROM files WHERE project_id IN (SELECT id FROM projects)) AS total_files,
        (SELECT CAST(sum(tokens_saved) AS BIGINT) FROM usage WHERE project_id IN (SELECT id FROM projects))
          AS total_saved_tokens,
        (SELECT count(*) FROM usage WHERE project_id IN (SELECT id FROM projects)) AS total_events""",
    ),
    "a14_active_projects": (
        lambda s, d: usage.active_project_totals(usage.usage_summary(T.usage_events(s, d))).withColumn(
            "avg_efficiency", F.round("avg_efficiency", 6)
        ),
        f"""WITH {T.USAGE_SQL}, {SUMMARY_CTE}
        SELECT count(*) AS active_projects, CAST(coalesce(sum(measured_savings), 0) AS BIGINT) AS total_savings,
        round(coalesce(avg(efficiency_ratio), 0.0), 6) AS avg_efficiency FROM summary
        WHERE measured_savings > 0 OR efficiency_ratio > 0""",
    ),
    "a15_turn_savings": (
        lambda s, d: usage.turn_savings(
            T.usage_events(s, d).filter(F.col("event_type").isin("index_substitute", "compression"))
            .withColumnRenamed("project_id", "session_id")
        ),
        f"""WITH {T.USAGE_SQL} SELECT project_id AS session_id, CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved,
        count(*) AS tools_intercepted, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS duration_ms
        FROM usage WHERE event_type IN ('index_substitute', 'compression')
        GROUP BY 1 HAVING sum(tokens_saved) <> 0""",
    ),
    "w1_cumulative_savings": (
        lambda s, d: _micros(usage.cumulative_savings(T.usage_events(s, d), "month", AS_OF)),
        f"""WITH {T.USAGE_SQL}, e AS (SELECT id, coalesce(ts, {NOW}) AS ts, tokens_saved FROM usage
          WHERE {_in_period('month')} AND tokens_saved > 0)
        SELECT id, epoch_us(ts) AS ts, tokens_saved, total FROM (
          SELECT *, CAST(sum(tokens_saved) OVER (ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM e)
        WHERE ts >= {NOW} - INTERVAL 30 DAY""",
    ),
    "w1_cumulative_by_project": (
        lambda s, d: _micros(usage.cumulative_savings(T.usage_events(s, d), "week", AS_OF, ["project_id"])),
        f"""WITH {T.USAGE_SQL}, e AS (SELECT project_id, id, coalesce(ts, {NOW}) AS ts, tokens_saved FROM usage
          WHERE {_in_period('week')} AND tokens_saved > 0)
        SELECT project_id, id, epoch_us(ts) AS ts, tokens_saved, total FROM (
          SELECT *, CAST(sum(tokens_saved) OVER (PARTITION BY project_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)
            AS BIGINT) AS total FROM e)
        WHERE ts >= {NOW} - INTERVAL 7 DAY""",
    ),
    "w2_recent_events": (
        lambda s, d: _micros(usage.recent_events(T.usage_events(s, d), 20, per_project=True))
        .drop("meta").withColumn("rank", F.col("rank").cast("bigint")),
        f"""WITH {T.USAGE_SQL} SELECT project_id, id, event_type, tokens_saved, tokens_used, epoch_us(ts) AS ts, rank
        FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY id DESC) AS rank FROM usage)
        WHERE rank <= 20""",
    ),
    "w3_recent_activity": (
        lambda s, d: _micros(usage.recent_activity(T.usage_events(s, d), "month", AS_OF)),
        f"""WITH {T.USAGE_SQL} SELECT event_type AS type, coalesce(m_path, m_query, '—') AS target, tokens_saved,
        epoch_us(coalesce(ts, {NOW})) AS ts, project_id AS project FROM usage WHERE {_in_period('month')}
        ORDER BY coalesce(usage.ts, {NOW}) DESC, id DESC LIMIT 20""",
    ),
    "w4_hot_files": (
        lambda s, d: index_stats.hot_files(_files_with_chunks(s, d)),
        f"""WITH {INDEX_CTES}, per AS (SELECT project_id, file, count(*) AS n FROM indexed GROUP BY 1, 2),
        lead AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, file) AS r FROM per)
        SELECT file AS path, max(n) AS count, arg_max(project_id, (n, project_id)) AS project FROM lead WHERE r <= 5
        GROUP BY file ORDER BY count DESC, path LIMIT 10""",
    ),
    "w5_recent_index_events": (
        lambda s, d: _micros(index_stats.recent_index_events(_changes(s, d))),
        """SELECT 'src/f' || json_extract_string(props, '$.k') || '.ts' AS file,
        CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'add' ELSE 'change' END AS action,
        epoch_us(ts) AS ts FROM events ORDER BY events.ts DESC, file DESC LIMIT 20""",
    ),
    "j1_index_health": (
        _health,
        f"""WITH {HEALTH_CTES} SELECT * FROM health""",
    ),
    "k1_freshness": (
        _freshness,
        f"""WITH {HEALTH_CTES},
        aged AS (SELECT *, epoch_us({NOW}) / 3600e6 - epoch_us(CAST(last_indexed AS TIMESTAMP)) / 3600e6 AS age FROM health)
        SELECT project_id, CAST(CASE WHEN age < 1 THEN 1.0 WHEN age < 24 THEN 0.8 WHEN age < 168 THEN 0.5 ELSE 0.2 END
          AS DOUBLE) AS freshness,
        greatest(0, files - zero_chunk_files) AS indexed_files,
        CASE WHEN files > 0 THEN round(greatest(0, files - zero_chunk_files) / CAST(files AS DOUBLE), 6) ELSE 0.0 END
          AS indexed_ratio FROM aged""",
    ),
    "j5_enrich_projects": (
        lambda s, d: index_stats.enrich_projects(
            T.projects(s, d),
            index_stats.index_counts(_files_with_chunks(s, d), T.file_hashes(s, d)),
            usage.usage_summary(T.usage_events(s, d)),
        ).withColumn("efficiency_ratio", F.round("efficiency_ratio", 6)),
        f"""WITH {T.USAGE_SQL}, {SUMMARY_CTE}, {T.PROJECTS_SQL}, {INDEX_CTES},
        top AS (SELECT * FROM projects ORDER BY last_seen DESC, id LIMIT 5)
        SELECT t.id AS project_id, t.name,
        (SELECT count(*) FROM indexed i WHERE i.project_id = t.id) AS chunks,
        (SELECT count(*) FROM files f WHERE f.project_id = t.id) AS files, CAST(0 AS BIGINT) AS edges,
        coalesce(s.measured_savings, 0) AS measured_savings, coalesce(s.searches, 0) AS searches,
        round(coalesce(s.efficiency_ratio, 0.0), 6) AS efficiency_ratio
        FROM top t LEFT JOIN summary s ON s.project_id = t.id""",
    ),
    "a1_index_counts": (
        lambda s, d: index_stats.index_counts(_files_with_chunks(s, d), T.file_hashes(s, d)).drop("edges"),
        f"""WITH {INDEX_CTES} SELECT f.project_id, f.n AS files, coalesce(c.n, 0) AS chunks
        FROM (SELECT project_id, count(*) AS n FROM files GROUP BY 1) f
        LEFT JOIN (SELECT project_id, count(*) AS n FROM indexed GROUP BY 1) c ON c.project_id = f.project_id""",
    ),
    "a2_chunks_by_lang_and_type": (
        lambda s, d: index_stats.chunks_by_lang_and_type(T.text_chunks(s, d)),
        f"""WITH {T.CHUNKS_SQL} SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM chunks GROUP BY lang
        UNION ALL SELECT 'type', type, count(*) FROM chunks GROUP BY type""",
    ),
    "a3_chunks_by_extension": (
        lambda s, d: index_stats.chunks_by_extension(T.text_chunks(s, d)),
        f"""WITH {T.CHUNKS_SQL} SELECT '.' || string_split(file, '.')[-1] AS ext, count(*) AS n FROM chunks GROUP BY 1""",
    ),
    "a4_top_files": (
        lambda s, d: index_stats.top_files(T.text_chunks(s, d)),
        f"""WITH {T.CHUNKS_SQL} SELECT file, count(*) AS n FROM chunks GROUP BY file ORDER BY n DESC, file LIMIT 10""",
    ),
}
