"""Registered compaction queries and their SQL equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuscope import dims, schemas
from corpuscope.functions import columns as C
from corpuscope.operators import compaction as K
from corpuscope.operators import log_parts, usage
from corpuscope.session import ensure_checkpoint_dir
from corpuscope.sources import tables as T
from corpuscope.sources.sinks import append_audit, audit_rows

ANSI_SQL = r"regexp_replace({0}, '\x1b\[[0-9;]*[A-Za-z]|\x1b\][^\x07]*\x07', '', 'g')"
STACK_SQL = r"""array_to_string(list_transform(string_split({0}, chr(10)), lambda l:
  CASE WHEN starts_with(l, ' ') AND regexp_matches(l, '^\s*(at\s+|\s*File\s+"|[^:]+:\d+:)')
       THEN regexp_replace(l, '^\s+', '') ELSE l END), chr(10))"""


def collapse_ctes(source: str, text: str, out: str) -> str:
    """Run collapse over (call_id, text) of ``source`` by windows; result in ``out``."""
    return f"""
{out}_l AS (SELECT call_id, i, parts[i] AS v, len(parts) AS n
  FROM (SELECT call_id, string_split({text}, chr(10)) AS parts FROM {source}), unnest(range(1, len(parts) + 1)) t(i)),
{out}_g AS (SELECT *, sum(b) OVER (PARTITION BY call_id ORDER BY i) AS g FROM (
  SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER (PARTITION BY call_id ORDER BY i) AND i > 1 THEN 0 ELSE 1 END AS b
  FROM {out}_l)),
{out}_r AS (SELECT call_id, g, min(i) AS i, any_value(v) AS v, count(*) AS k, any_value(n) AS n FROM {out}_g GROUP BY 1, 2),
{out} AS (SELECT call_id, string_agg(CASE WHEN n >= 5 AND k >= 3 THEN v || ' (x' || k || ')'
    ELSE v || repeat(chr(10) || v, CAST(k - 1 AS INT)) END, chr(10) ORDER BY i) AS txt FROM {out}_r GROUP BY 1)"""


def _case(column: str, table: dict, default: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


STRUCT_CTES = f"""{T.OUTPUTS_SQL},
s1 AS (SELECT call_id, {ANSI_SQL.format('output')} AS t FROM outputs),
s2 AS (SELECT call_id, {STACK_SQL.format('t')} AS t FROM s1),
{collapse_ctes('s2', 't', 's3')},
pre AS (SELECT o.*, s3.txt AS clean, length(o.output) - length(s3.txt) AS pre_saved,
   len(string_split(s3.txt, chr(10))) AS n_lines,
   {_case('tool_id', dims.TOOL_MAX_LINES, dims.DEFAULT_MAX_LINES)} AS max_lines,
   {_case('tool_id', dims.TOOL_MAX_CHARS, dims.DEFAULT_MAX_CHARS)} AS max_chars
  FROM outputs o JOIN s3 ON s3.call_id = o.call_id),
k1 AS (SELECT *, CASE WHEN n_lines > max_lines THEN
   array_to_string(string_split(clean, chr(10))[1:max_lines], chr(10)) || chr(10) || chr(10) ||
   '[... ' || (n_lines - max_lines) || ' lines omitted by {K.OMITTED_BY}]' ELSE clean END AS kept FROM pre),
k2 AS (SELECT *, CASE WHEN length(kept) > max_chars THEN substr(kept, 1, max_chars) || chr(10) || '[... ' ||
   (length(clean) - max_chars) || ' chars omitted by {K.OMITTED_BY}]' ELSE kept END AS cut,
   n_lines <= max_lines AND pre_saved = 0 AND length(clean) <= max_chars AS untouched FROM k1),
structural AS (SELECT call_id, tool_id, output, CASE WHEN untouched THEN output ELSE cut END AS compacted,
   CASE WHEN untouched THEN 'none' WHEN pre_saved > 0 THEN 'combined' ELSE 'truncate' END AS method FROM k2)"""


def _counter(word: str) -> str:
    return (
        rf"coalesce(sum(CAST(nullif(regexp_extract(v, '(\d+)\s+{word}', 1), '') AS BIGINT)), 0) AS {word}"
    )


SUMMARY_CTES = rf"""
c0 AS (SELECT call_id, tool_id, output, {ANSI_SQL.format('output')} AS t FROM outputs),
cl AS (SELECT call_id, tool_id, i, parts[i] AS v, len(parts) AS n FROM
  (SELECT *, string_split(t, chr(10)) AS parts FROM c0), unnest(range(1, len(parts) + 1)) u(i)),
counts AS (SELECT call_id, {", ".join(_counter(w) for w in K.COUNTERS)}, count(*) AS n,
   count(DISTINCT nullif(regexp_extract(v, '^(.+?):', 1), '')) AS prefixes,
   count(*) FILTER (trim(v, ' ' || chr(9)) <> '') AS texts FROM cl GROUP BY 1),
fails AS (SELECT call_id, i, regexp_extract(v, '(?i)(?:FAIL|✗|Error|error:|\bF\b)\s*[:\-]?\s*(.{{0,150}})', 1) AS f FROM cl),
ftypes AS (SELECT call_id, type, count(*) AS k, min(i) AS first FROM (
   SELECT call_id, i, CASE WHEN regexp_matches(f, '^[A-Z][A-Za-z]*Error') THEN regexp_extract(f, '^[A-Z][A-Za-z]*Error')
     WHEN trim(string_split(f, ':')[1]) <> '' THEN substr(trim(string_split(f, ':')[1]), 1, 60) ELSE 'Error' END AS type
   FROM fails WHERE f <> '') GROUP BY 1, 2),
ftop AS (SELECT call_id, count(*) AS kinds,
   string_agg('- ' || type || ': ' || k || 'x', chr(10) ORDER BY k DESC, first) FILTER (r <= 5) AS body FROM (
   SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY k DESC, first) AS r FROM ftypes) GROUP BY 1),
summaries AS (SELECT o.call_id, o.tool_id, CASE WHEN c.n < 3 THEN NULL
   WHEN o.tool_id IN ('bash','sh','zsh','fish','shell','test','jest','vitest','pytest') THEN
     CASE WHEN passed + failed + skipped + error > 0 THEN
       '{K.SUMMARY_TAG} Tests: ' || concat_ws(', ', CASE WHEN passed > 0 THEN passed || ' passed' END,
         CASE WHEN failed > 0 THEN failed || ' failed' END, CASE WHEN skipped > 0 THEN skipped || ' skipped' END,
         CASE WHEN error > 0 THEN error || ' error' END) ||
       coalesce(chr(10) || 'Failure types:' || chr(10) || f.body ||
         CASE WHEN f.kinds > 5 THEN chr(10) || '... (' || (f.kinds - 5) || ' more error types)' ELSE '' END, '') END
   WHEN o.tool_id IN ('grep','rg') THEN CASE WHEN prefixes > 0 THEN
       '{K.SUMMARY_TAG} grep: ' || c.n || ' matches in ' || prefixes || ' files' END
   WHEN o.tool_id IN ('glob','find','fd') THEN CASE WHEN texts > 0 THEN '{K.SUMMARY_TAG} ' || texts || ' files' END
   END AS summary
  FROM outputs o JOIN counts c ON c.call_id = o.call_id LEFT JOIN ftop f ON f.call_id = o.call_id)"""

RESULT_SQL = """SELECT call_id, tool_id, method, sha256(compacted) AS compacted_sha, CAST(length(output) AS BIGINT) AS original_len,
  CAST(length(compacted) AS BIGINT) AS compressed_len,
  CAST(CASE WHEN method = 'none' THEN 0 ELSE greatest(0, floor((length(output) - length(compacted) + 2) / 4.0)) END AS BIGINT)
    AS tokens_saved"""


def _shape(df):
    return df.select(
        "call_id", "tool_id", "method", F.sha2("compacted", 256).alias("compacted_sha"),
        F.col("original_len").cast("bigint").alias("original_len"),
        F.col("compressed_len").cast("bigint").alias("compressed_len"), "tokens_saved",
    )


def _in_parts(spark, folder):
    """Every output as a log in parts of three lines."""
    lines = C.lines_of("output")
    parts = C.let(lines, lambda x: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 3).cast("int")), lambda i: F.array_join(F.slice(x, i * 3 + 1, F.lit(3)), "\n")))
    cut = T.tool_outputs(spark, folder).select("call_id", "tool_id", F.posexplode(parts).alias("part", "text"))
    return _shape(log_parts.compact_parts(cut, log="call_id"))


def _sha(column):
    return F.sha2(column, 256)


FINAL_CTES = f"""{STRUCT_CTES}, {SUMMARY_CTES},
final AS (SELECT s.call_id, s.tool_id, s.output, coalesce(m.summary, s.compacted) AS compacted,
  CASE WHEN m.summary IS NOT NULL THEN 'semantic' ELSE s.method END AS method
  FROM structural s JOIN summaries m ON m.call_id = s.call_id)"""


def _substituted(spark, folder):
    out = K.compact(T.tool_outputs(spark, folder), semantic=True)
    eligible = out.filter(K.is_compressible("tool_id") & K.exceeds_threshold("output", 2000))
    done = K.substitute(eligible.drop("tokens_saved"), "output", "compacted")
    return done.filter("substituted").select("call_id", "tool_id", _sha(F.col("result")).alias("result_sha"), "tokens_saved")


def _rebuilt(spark, folder):
    """Structured file responses, their content swapped for the compacted text."""
    out = K.compact(T.tool_outputs(spark, folder).filter("tool_id = 'read'"), line_overrides={"read": 10})
    resp = out.withColumn(
        "resp",
        F.struct(
            F.lit("text").alias("type"),
            F.struct(
                F.col("call_id").alias("filePath"), F.col("output").alias("content"),
                C.line_count("output").cast("int").alias("numLines"), F.lit(1).alias("startLine"),
                C.line_count("output").cast("int").alias("totalLines"),
            ).alias("file"),
        ),
    )
    new = resp.select("call_id", K.rebuild_read_response("resp", "compacted").alias("r"))
    return new.select(
        "call_id", F.col("r.file.filePath").alias("file_path"), F.col("r.file.numLines").alias("num_lines"),
        F.col("r.file.totalLines").alias("total_lines"), _sha(F.col("r.file.content")).alias("content_sha"),
    )


def _audited(spark, folder):
    """Substitutions written as audit lines and read back; every third touches a sensitive path and is left out."""
    path = f"{ensure_checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    out = K.compact(T.tool_outputs(spark, folder), semantic=True)
    eligible = out.filter(K.is_compressible("tool_id") & K.exceeds_threshold("output", 2000))
    done = K.substitute(eligible.drop("tokens_saved"), "output", "compacted").withColumn(
        "path", F.concat(F.lit("/w/"), "call_id", F.when(F.substr("call_id", F.lit(2)).cast("bigint") % 3 == 0, "/.env").otherwise("/a.ts")))
    append_audit(audit_rows(done, path="path"), path)
    return spark.read.schema(schemas.AUDIT).json(path).select(
        "session_id", "tool_name", "path", "original_chars", "substitute_chars", F.unix_micros("ts").alias("ts"))


def _rebuilt_shell(spark, folder):
    """Structured shell responses, their stdout swapped for the compacted text; the other fields stay."""
    out = K.compact(T.tool_outputs(spark, folder).filter("tool_id = 'bash'"))
    resp = out.withColumn("resp", F.struct(
        F.col("output").alias("stdout"), F.col("call_id").alias("stderr"), F.lit(False).alias("interrupted"),
        F.lit(False).alias("isImage"), F.lit(True).alias("noOutputExpected")))
    new = resp.select("call_id", K.rebuild_shell_response("resp", "compacted").alias("r"))
    return new.select("call_id", _sha(F.col("r.stdout")).alias("stdout_sha"), F.col("r.stderr").alias("stderr"), F.col("r.noOutputExpected").alias("quiet"))


def _client_tools(spark, folder):
    """Tools of which a client compacts the output, by tool, variants of the shell included."""
    tool = F.concat("tool_id", F.when(F.substr("call_id", F.lit(2)).cast("bigint") % 2 == 0, "-x").otherwise(""))
    out = T.tool_outputs(spark, folder).select(tool.alias("tool"), K.is_client_compressible(tool).alias("client"))
    return out.groupBy("tool", "client").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "s16_audit_log": (
        _audited,
        f"""WITH {FINAL_CTES} SELECT o.session_id, f.tool_id AS tool_name, '/w/' || f.call_id || '/a.ts' AS path,
        CAST(length(f.output) AS BIGINT) AS original_chars, CAST(length(f.compacted) AS BIGINT) AS substitute_chars,
        (1704067200 + CAST(substr(f.call_id, 2) AS BIGINT) * 60) * 1000000 AS ts
        FROM final f JOIN outputs o ON o.call_id = f.call_id WHERE f.tool_id <> 'other' AND length(f.output) > 2000
          AND length(f.compacted) < length(f.output) AND CAST(substr(f.call_id, 2) AS BIGINT) % 3 <> 0""",
    ),
    "c14_rebuild_shell": (
        _rebuilt_shell,
        f"""WITH {STRUCT_CTES} SELECT call_id, sha256(compacted) AS stdout_sha, call_id AS stderr, true AS quiet
        FROM structural WHERE tool_id = 'bash'""",
    ),
    "c12_client_tools": (
        _client_tools,
        f"""WITH {T.OUTPUTS_SQL}, t AS (SELECT tool_id || CASE WHEN CAST(substr(call_id, 2) AS BIGINT) % 2 = 0 THEN '-x' ELSE '' END AS tool FROM outputs)
        SELECT tool, tool IN ({", ".join(f"'{t}'" for t in dims.CLIENT_TOOLS)}) OR starts_with(tool, 'bash') OR starts_with(tool, 'sh') AS client,
        count(*) AS n FROM t GROUP BY 1, 2""",
    ),
    "c1_strip_ansi": (
        lambda s, d: T.tool_outputs(s, d).select("call_id", _sha(K.strip_ansi("output")).alias("sha")),
        f"WITH {T.OUTPUTS_SQL} SELECT call_id, sha256({ANSI_SQL.format('output')}) AS sha FROM outputs",
    ),
    "c2_collapse_runs": (
        lambda s, d: T.tool_outputs(s, d).select("call_id", _sha(K.collapse_runs("output")).alias("sha")),
        f"WITH {T.OUTPUTS_SQL}, {collapse_ctes('outputs', 'output', 'r')} SELECT call_id, sha256(txt) AS sha FROM r",
    ),
    "c3_trim_stack_frames": (
        lambda s, d: T.tool_outputs(s, d).select("call_id", _sha(K.trim_stack_frames("output")).alias("sha")),
        f"WITH {T.OUTPUTS_SQL} SELECT call_id, sha256({STACK_SQL.format('output')}) AS sha FROM outputs",
    ),
    "c4_preprocess_ansi_only": (
        lambda s, d: K.preprocess(T.tool_outputs(s, d), "output", stack=False, dedupe=False)
        .select("call_id", F.col("pre_saved").cast("bigint").alias("pre_saved")),
        f"""WITH {T.OUTPUTS_SQL} SELECT call_id, CAST(length(output) - length({ANSI_SQL.format('output')}) AS BIGINT)
        AS pre_saved FROM outputs""",
    ),
    "c7_compact_structural": (
        lambda s, d: _shape(K.compact(T.tool_outputs(s, d))),
        f"WITH {STRUCT_CTES} {RESULT_SQL} FROM structural",
    ),
    "c2_c5_compact_parts": (
        _in_parts,
        f"WITH {STRUCT_CTES} {RESULT_SQL} FROM structural",
    ),
    "c8_c10_summaries": (
        lambda s, d: C.pinned(
            T.tool_outputs(s, d), summary=C.let(K.strip_ansi("output"), lambda t: K.semantic_summary("tool_id", t))
        ).select("call_id", "summary").filter(F.col("summary").isNotNull()),
        f"WITH {T.OUTPUTS_SQL}, {SUMMARY_CTES} SELECT call_id, summary FROM summaries WHERE summary IS NOT NULL",
    ),
    "c11_compact_semantic": (
        lambda s, d: _shape(K.compact(T.tool_outputs(s, d), semantic=True)),
        f"WITH {FINAL_CTES} {RESULT_SQL} FROM final",
    ),
    "c13_substitute": (
        _substituted,
        f"""WITH {FINAL_CTES} SELECT call_id, tool_id, sha256(compacted) AS result_sha,
        CAST(floor((length(output) - length(compacted) + 2) / 4.0) AS BIGINT) AS tokens_saved FROM final
        WHERE tool_id <> 'other' AND length(output) > 2000 AND length(compacted) < length(output)""",
    ),
    "c14_rebuild_response": (
        _rebuilt,
        f"""WITH {STRUCT_CTES.replace("WHEN 'read' THEN 25", "WHEN 'read' THEN 10")}
        SELECT call_id, call_id AS file_path, CAST(len(string_split(compacted, chr(10))) AS INT) AS num_lines,
        CAST(len(string_split(output, chr(10))) AS INT) AS total_lines, sha256(compacted) AS content_sha
        FROM structural WHERE tool_id = 'read'""",
    ),
    "c15_compaction_events": (
        lambda s, d: usage.rollup_by_type(
            K.compaction_events(
                K.compact(
                    T.tool_outputs(s, d).filter(K.is_compressible("tool_id"))
                    .withColumn("project_id", F.concat(F.lit("of-"), "session_id")), semantic=True,
                ),
                F.col("project_id"),
            ),
            "project_id",
        ),
        f"""WITH {FINAL_CTES}, r AS ({RESULT_SQL} FROM final WHERE tool_id <> 'other')
        SELECT 'of-' || o.session_id AS project_id, 'compression' AS event_type, count(*) AS n,
        CAST(sum(r.tokens_saved) AS BIGINT) AS saved
        FROM r JOIN outputs o ON o.call_id = r.call_id WHERE r.tokens_saved > 0 GROUP BY 1""",
    ),
    "a16_compaction_status": (
        lambda s, d: usage.compaction_status(K.compact(T.tool_outputs(s, d), semantic=True)).select("semantic_saved"),
        f"""WITH {FINAL_CTES} SELECT CAST(coalesce(sum(length(output) - length(compacted)) FILTER (method = 'semantic'), 0)
        AS BIGINT) AS semantic_saved FROM final""",
    ),
    "f1_token_estimates": (
        lambda s, d: T.table(s, d, "documents").groupBy("source", "lang").agg(
            F.sum(C.estimate_text_tokens("text")).alias("tokens")
        ),
        """SELECT source, lang, CAST(sum(floor((length(text) + 2) / 4.0)) AS BIGINT) AS tokens FROM documents GROUP BY 1, 2""",
    ),
}
