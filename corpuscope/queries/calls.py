"""Registered queries over call logs: classification, repeated reads, reuse, terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.operators import classify, sessions, usage
from corpuscope.sources import tables as T

# Events again, as the SQL side sees them: e(event_id), k, c = position of the command.
CALLS_SQL = """
calls AS (SELECT event_id, user_id, ts, json_extract_string(props, '$.k') AS k,
  ['read','grep','bash','glob','webfetch','sh','websearch','bash','Read','Bash','edit'][event_id % 11 + 1] AS tool,
  event_id % 12 AS c, CASE event_id % 3 WHEN 0 THEN '/home/p/' WHEN 1 THEN '' ELSE '/etc/' END AS pre FROM events),
known AS (SELECT *, CASE
    WHEN tool = 'read' AND pre <> '/etc/' THEN 'read' WHEN tool = 'grep' THEN 'grep' WHEN tool = 'glob' THEN 'glob'
    WHEN tool = 'webfetch' THEN 'webfetch' WHEN tool = 'websearch' THEN 'websearch'
    WHEN tool IN ('bash', 'sh') AND c IN (0, 3, 9, 10) THEN 'bash-read'
    WHEN tool IN ('bash', 'sh') AND c IN (1, 4, 5) THEN 'bash-grep' END AS kind,
  CASE WHEN tool = 'read' AND pre <> '/etc/' THEN '/home/p/src/f' || k || '.ts' WHEN tool = 'webfetch' THEN 'https://e.org/' || k
    WHEN tool IN ('bash', 'sh') THEN CASE c WHEN 0 THEN '/home/p/src/f' || k || '.ts' WHEN 3 THEN '/home/p/src/f' || k || '.ts'
      WHEN 9 THEN '/home/p/./a/../b' || k || '.py' WHEN 10 THEN '/home/p/.env' WHEN 1 THEN '/home/p/src/f' || k || '.ts'
      WHEN 4 THEN '/home/p/lib/f' || k || '.go' WHEN 5 THEN '/home/p/data/' || k || '.json' END END AS path,
  CASE WHEN tool IN ('grep', 'glob') THEN 'pat' || k WHEN tool = 'websearch' THEN 'what is ' || k
    WHEN tool IN ('bash', 'sh') THEN CASE c WHEN 1 THEN 'fn ' || k WHEN 4 THEN 'needle' || k WHEN 5 THEN '.a' || k END END AS query
  FROM calls)"""


def _classified(spark, folder):
    return classify.classify_calls(T.tool_calls(spark, folder))


def _reads(spark, folder):
    """Reads of a few hot paths, many per session."""
    return T.table(spark, folder, "events").select(
        F.concat(F.lit("s"), F.col("user_id") % 40).alias("session_id"),
        F.concat(F.lit("/f"), (F.get_json_object("props", "$.k").cast("int") / 50).cast("int")).alias("path"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("event_id") % 900).alias("ts"), F.col("event_id").alias("id"),
        F.lit(1000).alias("chars"),
    )


READS_SQL = """reads AS (SELECT 's' || user_id % 40 AS session_id, '/f' || CAST(json_extract_string(props, '$.k') AS INT) // 50 AS path,
  event_id % 900 AS sec, event_id AS id FROM events),
looped AS (SELECT *, CASE WHEN sec - f < 300 THEN row_number() OVER (PARTITION BY session_id, path ORDER BY sec, id) ELSE 1 END AS n
  FROM (SELECT *, min(sec) OVER (PARTITION BY session_id, path) AS f FROM reads))"""


def _edits(spark, folder):
    return _reads(spark, folder).filter(F.col("id") % 13 == 0)


def _reuse_log(spark, folder):
    e = F.col("event_id")
    return T.table(spark, folder, "events").select(
        F.concat(F.lit("read:"), F.col("user_id") % 25).alias("key"), F.col("ts").cast("timestamp").alias("ts"), e.alias("id"),
        (F.floor(e / 400) * 7).cast("bigint").alias("mtime_ms"), F.floor("value").alias("tokens"),
    )


QUERIES = {
    "p1_classify_calls": (
        lambda s, d: _classified(s, d).filter(F.col("kind").isNotNull()).select("call_id", "tool", "kind", "path", "query"),
        f"WITH {CALLS_SQL} SELECT 'k' || event_id AS call_id, tool, kind, path, query FROM known WHERE kind IS NOT NULL",
    ),
    "p2_classify_reduced": (
        lambda s, d: classify.classify_reduced(T.tool_calls(s, d)).filter(F.col("kind").isNotNull())
        .select("call_id", "kind", "path", "tool_id"),
        f"""WITH {CALLS_SQL} SELECT 'k' || event_id AS call_id,
        CASE WHEN tool = 'Bash' AND c IN (2, 3, 4, 7) THEN 'compress' ELSE 'read' END AS kind,
        CASE WHEN tool = 'Read' THEN pre || 'src/f' || k || '.ts' WHEN c = 0 THEN '/home/p/src/f' || k || '.ts'
          WHEN c = 6 THEN '/home/p/-20' END AS path,
        CASE WHEN tool = 'Bash' AND c IN (2, 3, 4) THEN 'git' WHEN tool = 'Bash' AND c = 7 THEN 'npm' END AS tool_id
        FROM calls WHERE (tool = 'Read' AND event_id % 5 <> 0) OR (tool = 'Bash' AND c IN (0, 2, 3, 4, 6, 7))""",
    ),
    "p3_interception_rates": (
        lambda s, d: usage.interception_rates(_classified(s, d), "tool").withColumn("rate", F.round("rate", 6)),
        f"""WITH {CALLS_SQL} SELECT tool, count(*) AS total, count(kind) AS intercepted,
        round(count(kind) / CAST(count(*) AS DOUBLE), 6) AS rate FROM known GROUP BY 1""",
    ),
    "w6_loop_detection": (
        lambda s, d: sessions.detect_loops(_reads(s, d)).select("session_id", "path", "id", "count", "looping"),
        f"WITH {READS_SQL} SELECT session_id, path, id, n AS count, n >= 3 AS looping FROM looped",
    ),
    "w6_loop_hints": (
        lambda s, d: sessions.loop_hints(sessions.detect_loops(_reads(s, d)))
        .groupBy("session_id").agg(F.count(F.lit(1)).alias("hints"), F.sum("tokens_saved").alias("tokens_saved")),
        f"""WITH {READS_SQL}, h AS (SELECT session_id, 1000 - length('{sessions.HINT.replace('%s', '')}' || n) AS d FROM looped WHERE n >= 3)
        SELECT session_id, count(*) AS hints, CAST(sum(floor((d + 2) / 4.0)) AS BIGINT) AS tokens_saved FROM h GROUP BY 1""",
    ),
    "w7_conversation_terms": (
        lambda s, d: sessions.conversation_terms(T.table(s, d, "conversations")).select(
            "conv_id", F.array_join("terms", " ").alias("terms")
        ),
        """WITH t AS (SELECT conv_id, turn, i AS pos, ws[i] AS term FROM (SELECT conv_id, turn,
            list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda w: length(w) >= 3)[1:10] AS ws
            FROM conversations WHERE role = 'user'), unnest(range(1, len(ws) + 1)) u(i)),
        l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, pos DESC) AS r FROM t),
        f AS (SELECT conv_id, term, min((turn, pos)) AS p FROM l WHERE r <= 30 GROUP BY 1, 2)
        SELECT conv_id, string_agg(term, ' ' ORDER BY p) AS terms FROM f GROUP BY 1""",
    ),
    "j7_unedited_reads": (
        lambda s, d: sessions.not_edited_before(_reads(s, d), _edits(s, d)).select("session_id", "path", "id"),
        f"""WITH {READS_SQL} SELECT session_id, path, id FROM reads r WHERE NOT EXISTS (SELECT 1 FROM reads e
        WHERE e.id % 13 = 0 AND e.session_id = r.session_id AND e.path = r.path AND e.sec <= r.sec)""",
    ),
    "j8_reuse": (
        lambda s, d: sessions.reuse(_reuse_log(s, d), 3_600_000).select("key", "calls", "hits", "tokens_saved"),
        """WITH RECURSIVE l AS (SELECT 'read:' || user_id % 25 AS key, epoch_ms(ts) AS t, max(event_id // 400 * 7) AS m,
          count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS v, CAST(arg_min(floor(value), event_id) AS BIGINT) AS f FROM events GROUP BY 1, 2),
        c AS (SELECT key, min(t) AS t, arg_min(m, t) AS m FROM l GROUP BY key
          UNION ALL
          SELECT c.key, x.t, x.m FROM c, LATERAL (SELECT l.t, l.m FROM l WHERE l.key = c.key AND l.t > c.t
            AND (l.t > c.t + 3600000 OR l.m > c.m) ORDER BY l.t LIMIT 1) x)
        SELECT l.key, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(n) - count(c.t) AS BIGINT) AS hits,
          CAST(sum(v) - sum(CASE WHEN c.t IS NOT NULL THEN f ELSE 0 END) AS BIGINT) AS tokens_saved
        FROM l LEFT JOIN c ON c.key = l.key AND c.t = l.t GROUP BY l.key""",
    ),
    "r7_unexpired_edits": (
        lambda s, d: sessions.unexpired(_reads(s, d), "2024-01-02 00:05:00").groupBy("session_id").agg(F.count(F.lit(1)).alias("n")),
        f"""WITH {READS_SQL} SELECT session_id, count(*) AS n FROM reads WHERE sec > 300 GROUP BY 1""",
    ),
}
