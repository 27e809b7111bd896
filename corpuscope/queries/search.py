"""Registered search queries and their SQL equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuscope.operators import rendering as R
from corpuscope.operators import search as Q
from corpuscope.operators.postings import PostingIndex, indexed
from corpuscope.plans.tools import Workspace
from corpuscope.session import ensure_checkpoint_dir
from corpuscope.sources import tables as T

# Query texts asked of every project: (id, text, n).
TEMPLATES = (
    (1, "thing", 10),
    (2, "that inth", 0),
    (3, "un erea", 5),
    (4, "src/ther the", 20),
    (5, 'type:heading lang:Python "and the"', 10),
    (6, "file:/en/ with", 500),
    (7, "", 10),
    (8, "TYPE:class ther.on", 3),
)
# The same, as a reader of SQL would decompose them by hand:
# id, match terms, any_mode, dead, fallback words, type, file, lang, n.
DECOMPOSED = (
    (1, "['thing']", "false", "false", "['thing']", "NULL", "NULL", "NULL", 10),
    (2, "['that','inth']", "false", "false", "['that','inth']", "NULL", "NULL", "NULL", 10),
    (3, "['erea']", "false", "true", "['un','erea']", "NULL", "NULL", "NULL", 5),
    (4, "['src','ther','the']", "true", "false", "['src','ther','the']", "NULL", "NULL", "NULL", 20),
    (5, "['and','the']", "false", "false", "['and','the']", "'heading'", "NULL", "'python'", 10),
    (6, "['with']", "false", "false", "['with']", "NULL", "'/en/'", "NULL", 200),
    (8, "['ther']", "true", "false", "['ther','on']", "'class'", "NULL", "NULL", 3),
)


def templates_sql(filters: bool = True, n: int | None = None, scopes: dict | None = None) -> str:
    none = "CAST(NULL AS VARCHAR)"
    scope = lambda tid: none if not scopes or not scopes.get(tid) else f"'{scopes[tid]}'"
    rows = [(*r[:5], *(r[5:8] if filters else (none, scope(r[0]), none)), n or r[8]) for r in DECOMPOSED]
    values = ", ".join("(" + ", ".join(str(v) for v in r) + ")" for r in rows)
    return f"""
tq(tid, terms, any_mode, dead, words, f_type, f_file, f_lang, n) AS (VALUES {values}),
qs AS (SELECT p.project_id || ':' || tid AS query_id, p.project_id, tq.* FROM tq,
  (SELECT DISTINCT project_id FROM files) p)"""


TEMPLATES_SQL = templates_sql()


def queries_for_all(spark, folder):
    per = F.array(*[F.struct(F.lit(i).alias("tid"), F.lit(q).alias("q"), F.lit(n).alias("n")) for i, q, n in TEMPLATES])
    return (
        T.table(spark, folder, "documents").select("source").distinct()
        .select(F.concat(F.lit("p"), F.substring("source", 4, 9)).alias("project_id"), F.explode(per).alias("t"))
        .select(F.concat_ws(":", "project_id", "t.tid").alias("query_id"), "project_id", "t.q", "t.n")
    )


def benchmark_queries(spark, folder):
    """Every benchmark passage as a whole, asked of every project."""
    projects = T.table(spark, folder, "documents").select(F.concat(F.lit("p"), F.substring("source", 4, 9)).alias("project_id")).distinct()
    return T.table(spark, folder, "benchmark").crossJoin(F.broadcast(projects)).select(
        F.concat(F.lit("b"), "item_id", F.lit(":"), "project_id").alias("query_id"), "project_id", F.col("text").alias("q"), F.lit(10).alias("n"))


BENCH_SQL = """
bq AS (SELECT item_id, text, array_to_string(list_filter(regexp_extract_all(lower(text), '[^\\s]+'), lambda t: length(t) >= 2), ' ') AS qq FROM benchmark),
bw AS (SELECT *, contains(qq, '/') OR regexp_matches(trim(qq), '\\.[a-z0-9]{1,5}$') AS any_mode,
    list_filter(string_split_regex(qq, '[^a-z0-9_]+'), lambda t: length(t) >= 2) AS w,
    list_filter(string_split_regex(qq, '[^a-z0-9]+'), lambda t: length(t) >= 2) AS f FROM bq),
bt AS (SELECT *, list_filter(w, lambda t, i: list_position(w, t) = i)[1:30] AS m, list_filter(f, lambda t, i: list_position(f, t) = i)[1:30] AS words FROM bw),
qs AS (SELECT 'b' || item_id || ':' || p.project_id AS query_id, p.project_id, list_filter(m, lambda t: length(t) >= 3) AS terms,
    any_mode, NOT any_mode AND len(list_filter(m, lambda t: length(t) >= 3)) < len(m) AS dead, words,
    CAST(NULL AS VARCHAR) AS f_type, CAST(NULL AS VARCHAR) AS f_file, CAST(NULL AS VARCHAR) AS f_lang, 10 AS n
  FROM bt, (SELECT DISTINCT project_id FROM files) p)"""

# Expects qs and chunks; gives ranked(query_id, ..., score, rank).
SEARCH_SQL = """
hits AS (SELECT q.query_id, q.project_id, t.term, c.file, c.line, c.type, c.name, c.line_end, c.lang, c.content, c.body,
    len(list_filter(range(1, length(c.name) + 1), lambda i: substr(lower(c.name), i, length(t.term)) = t.term))
    + len(list_filter(range(1, length(c.content) + 1), lambda i: substr(lower(c.content), i, length(t.term)) = t.term)) AS tf,
    greatest(0, length(c.name) - 2) + greatest(0, length(c.content) - 2) AS dl
  FROM qs q, unnest(q.terms) t(term), chunks c
  WHERE NOT q.dead AND c.project_id = q.project_id AND (contains(lower(c.name), t.term) OR contains(lower(c.content), t.term))),
cs AS (SELECT project_id, count(*) AS nd,
    sum(greatest(0, length(name) - 2) + greatest(0, length(content) - 2)) / CAST(count(*) AS DOUBLE) AS al
  FROM chunks GROUP BY 1),
dfq AS (SELECT query_id, term, count(*) AS dfreq FROM hits GROUP BY 1, 2),
found AS (SELECT h.query_id, h.file, h.line, h.type, h.name, h.line_end, h.lang, any_value(h.content) AS content,
    any_value(h.body) AS body,
    sum(-(CASE WHEN ln((nd - dfreq + 0.5) / (dfreq + 0.5)) > 0 THEN ln((nd - dfreq + 0.5) / (dfreq + 0.5)) ELSE 1e-6 END)
      * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))) AS score, count(*) AS k
  FROM hits h JOIN cs ON cs.project_id = h.project_id JOIN dfq d ON d.query_id = h.query_id AND d.term = h.term
  GROUP BY h.query_id, h.file, h.line, h.type, h.name, h.line_end, h.lang),
ok AS (SELECT f.* EXCLUDE (k) FROM found f JOIN qs q ON q.query_id = f.query_id WHERE q.any_mode OR k = len(q.terms)),
rest AS (SELECT DISTINCT q.query_id, c.file, c.line, c.type, c.name, c.line_end, c.lang, c.content, c.body, 0.0 AS score
  FROM qs q, unnest(q.words) w(word), chunks c
  WHERE q.query_id NOT IN (SELECT query_id FROM ok) AND c.project_id = q.project_id
    AND (contains(lower(c.name), w.word) OR contains(lower(c.content), w.word) OR contains(lower(c.body), w.word))),
ranked AS (SELECT * FROM (
  SELECT u.*, row_number() OVER (PARTITION BY u.query_id ORDER BY round(u.score, 12), u.file, u.line, u.type, u.name) AS rank, q.n
  FROM (SELECT * FROM ok UNION ALL SELECT * FROM rest) u JOIN qs q ON q.query_id = u.query_id
  WHERE (f_type IS NULL OR u.type = f_type) AND (f_file IS NULL OR contains(u.file, f_file)) AND (f_lang IS NULL OR u.lang = f_lang))
  WHERE rank <= n)"""


def _ranked(queries, **options):
    def run(spark, folder):
        out = Q.search(T.text_chunks(spark, folder), queries(spark, folder), **options)
        return out.select(
            "query_id", "file", "name", "type", F.col("line").cast("bigint").alias("line"), "lang",
            F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"),
        )

    return run


RANKED_COLUMNS = """SELECT query_id, file, name, type, CAST(line AS BIGINT) AS line, lang,
  round(CAST(score AS DOUBLE), 6) AS score, rank FROM ranked"""


_STORED: dict[tuple[str, str], PostingIndex] = {}


def stored_index(spark, folder) -> PostingIndex:
    """The posting index of the line chunks, kept in the shared folder for all searches of an application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        index = PostingIndex(spark, f"{ensure_checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}")
        index.add(T.text_chunks(spark, folder), "chunks")
        _STORED[key] = index
    return _STORED[key]


def _stored(queries, **options):
    def run(spark, folder):
        out = stored_index(spark, folder).search(queries(spark, folder), **options)
        return out.select(
            "query_id", "file", "name", "type", F.col("line").cast("bigint").alias("line"), "lang",
            F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"),
        )

    return run


def _posting_table(spark, folder):
    """Rows and occurrences of each word of each project, from the stored postings."""
    held = stored_index(spark, folder).read("postings").withColumn("entries", indexed("entries")).where(F.size("entries") > 0)
    return held.groupBy("project_id", "word").agg(
        F.sum(F.size("entries").cast("bigint")).alias("docs"),
        F.sum(F.aggregate("entries", F.lit(0).cast("bigint"), lambda acc, e: acc + e["tf"])).alias("occurrences"))


def _parsed(spark, folder):
    q = T.table(spark, folder, "conversations").select(
        "conv_id", "turn",
        F.concat(F.lit('"Two Words" type:Class LANG:"Go" '), F.col("text"), F.lit(" file:src/a.ts 'x y'")).alias("q"),
    )
    p = Q.parse_queries(q)
    p = p.withColumn("phrases", Q.phrase_query(p)).withColumn("match", Q.match_terms("text"))
    return p.select(
        "conv_id", "turn", "type_filter", "file_filter", "lang_filter",
        F.array_join("terms", "|").alias("terms"), F.array_join("match", "|").alias("match"),
        "phrases", Q.is_path_like("text").alias("any_mode"),
    )


PARSED_SQL = r"""WITH raw AS (SELECT conv_id, turn,
    '"Two Words" type:Class LANG:"Go" ' || text || ' file:src/a.ts ''x y''' AS q FROM conversations),
parts AS (SELECT *, regexp_extract_all(q, '(?:[^\s"'']+|"[^"]*"|''[^'']*'')+') AS ps FROM raw),
t AS (SELECT *, list_filter(list_transform(list_filter(ps, lambda p: NOT regexp_matches(p, '(?i)^(type|file|lang):.')),
    lambda p: lower(CASE WHEN (starts_with(p, '"') AND ends_with(p, '"')) OR (starts_with(p, '''') AND ends_with(p, ''''))
      THEN substr(p, 2, greatest(length(p) - 2, 0)) ELSE p END)), lambda x: length(x) >= 2) AS terms FROM parts),
m AS (SELECT *, array_to_string(terms, ' ') AS text FROM t),
w AS (SELECT *, list_filter(string_split_regex(text, '[^a-z0-9_]+'), lambda x: length(x) >= 2) AS ws FROM m)
SELECT conv_id, turn, 'class' AS type_filter, 'src/a.ts' AS file_filter, 'go' AS lang_filter,
  array_to_string(terms, '|') AS terms,
  array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i)[1:30], '|') AS match,
  array_to_string(list_transform(list_concat(terms, ['class']), lambda x: '"' || x || '"'), ' OR ') AS phrases,
  contains(text, '/') OR regexp_matches(trim(text), '(?i)\.[a-z0-9]{1,5}$') AS any_mode
FROM w WHERE len(ws) >= 0"""


def _requests(spark, folder):
    """A line-range read of every file."""
    return T.files(spark, folder).select(
        F.concat(F.lit("r"), "doc_id").alias("request_id"), "project_id", "file",
        (F.col("doc_id") % 4).alias("offset"), (F.col("doc_id") % 3 * 4).alias("limit"),
    )


REQ_SQL = """req AS (SELECT 'r' || doc_id AS request_id, project_id, file, doc_id % 4 AS off, doc_id % 3 * 4 AS lim FROM files),
overlap AS (SELECT r.request_id, c.* FROM chunks c JOIN req r ON r.project_id = c.project_id AND r.file = c.file
  WHERE (off = 0 AND lim = 0) OR (line_end >= greatest(1, off) AND (lim = 0 OR line <= greatest(1, off) + lim - 1)))"""


def _snippets(spark, folder):
    picked = Q.chunks_in_range(T.text_chunks(spark, folder), _requests(spark, folder))
    return R.file_snippets(picked, ["request_id"], F.lit("/work"))


def _pages(spark, folder):
    out = stored_index(spark, folder).search(queries_for_all(spark, folder), payload=("line_end", "lang", "body"))
    return R.result_page(out, F.lit("/work")).select("query_id", F.sha2("text", 256).alias("sha"))


# File filters of the snippet search, by query text: none, a directory, an absolute prefix, part of a name.
SCOPES = ((1, None), (2, "/en/"), (3, None), (4, "/work/src1/"), (5, "d1"), (6, "/work/src0/src"), (7, None), (8, "/fr/d2"))


def _snippet_search(spark, folder):
    """Compact pages with the header line, and the saving each search logs; the filter applies before the ranking."""
    scope = F.create_map(*[F.lit(x) for i, f in SCOPES if f for x in (i, f)])
    queries = queries_for_all(spark, folder).withColumn(
        "file_filter", F.try_element_at(scope, F.get(F.split("query_id", ":"), F.lit(1)).cast("int")))
    work = Workspace(stored_index(spark, folder), None, None)
    return work.search_snippet(queries, F.lit("/work")).select("query_id", "text", "tokens_saved")


SNIP_LINES = r"""CASE WHEN len(bl) <= 12 THEN bl ELSE bl[1:9] || ['… (' || (len(bl) - 12) || ' more lines) …'] || bl[-3:] END"""

QUERIES = {
    "q1_q3_parse_queries": (_parsed, PARSED_SQL),
    "q8_search_ranked": (
        _ranked(queries_for_all),
        f"WITH {T.CHUNKS_SQL}, {TEMPLATES_SQL}, {SEARCH_SQL} {RANKED_COLUMNS}",
    ),
    "q4_posting_table": (
        _posting_table,
        f"""WITH {T.CHUNKS_SQL}, numbered AS (SELECT row_number() OVER () AS id, * FROM chunks),
        held AS (SELECT id, project_id, unnest(list_concat(regexp_extract_all(lower(name), '[a-z0-9_]+'), regexp_extract_all(lower(content), '[a-z0-9_]+'))) AS word
          FROM numbered)
        SELECT project_id, word, count(DISTINCT id) AS docs, count(*) AS occurrences FROM held WHERE length(word) >= 3 GROUP BY 1, 2""",
    ),
    "q8_search_stored": (
        _stored(queries_for_all),
        f"WITH {T.CHUNKS_SQL}, {TEMPLATES_SQL}, {SEARCH_SQL} {RANKED_COLUMNS}",
    ),
    "q8_search_by_trigram": (
        _ranked(queries_for_all, by_gram=True),
        f"WITH {T.CHUNKS_SQL}, {TEMPLATES_SQL}, {SEARCH_SQL} {RANKED_COLUMNS}",
    ),
    "q8_search_benchmark_batch": (
        _stored(benchmark_queries),
        f"WITH {T.CHUNKS_SQL}, {BENCH_SQL}, {SEARCH_SQL} {RANKED_COLUMNS}",
    ),
    "q6_search_unranked": (
        _ranked(queries_for_all, ranked=False, filters=False),
        f"""WITH {T.CHUNKS_SQL}, {templates_sql(filters=False)}, {SEARCH_SQL.replace('round(u.score, 12), ', '')}
        {RANKED_COLUMNS.replace('round(CAST(score AS DOUBLE), 6)', 'CAST(0 AS DOUBLE)')}""",
    ),
    "q9_chunks_of_file": (
        lambda s, d: Q.chunks_of_file(T.text_chunks(s, d), T.files(s, d))
        .select("file", F.col("line").cast("bigint").alias("line"), "name", "type"),
        f"WITH {T.CHUNKS_SQL} SELECT file, CAST(line AS BIGINT) AS line, name, type FROM chunks",
    ),
    "q10_line_ranges": (
        lambda s, d: Q.chunks_in_range(T.text_chunks(s, d), _requests(s, d))
        .select("request_id", "file", F.col("line").cast("bigint").alias("line"), "name"),
        f"WITH {T.CHUNKS_SQL}, {REQ_SQL} SELECT request_id, file, CAST(line AS BIGINT) AS line, name FROM overlap",
    ),
    "q11_file_snippets": (
        _snippets,
        f"""WITH {T.CHUNKS_SQL}, {REQ_SQL},
        r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY line, name, type) AS k,
          count(*) OVER (PARTITION BY request_id) AS n FROM overlap)
        SELECT request_id, string_agg(type || ' ' || name || ' @ ' || substr(file, 7) || ':' ||
          CASE WHEN line_end > line THEN line || '-' || line_end ELSE CAST(line AS VARCHAR) END || chr(10) || body,
          chr(10) ORDER BY k) || CASE WHEN any_value(n) > 5 THEN chr(10) || '[' || (any_value(n) - 5) ||
          ' more chunks omitted. Use offset/limit to see more.]' ELSE '' END AS text
        FROM r WHERE k <= 5 GROUP BY request_id""",
    ),
    "q12_snippets": (
        lambda s, d: T.files(s, d).select("file", F.sha2(R.snippet("content", F.lit(95)), 256).alias("sha")),
        f"""WITH {T.FILES_SQL}, b AS (SELECT file, content, string_split(content, chr(10)) AS bl FROM files),
        s AS (SELECT file, content, {SNIP_LINES} AS shown FROM b)
        SELECT file, sha256(CASE WHEN content = '' THEN '' ELSE array_to_string(list_transform(shown, lambda l, i:
          CASE WHEN starts_with(l, '…') AND ends_with(l, '…') THEN '   │ ' || l ELSE
            lpad(CAST(94 + i - len(list_filter(shown[1:i-1], lambda x: starts_with(x, '…') AND ends_with(x, '…'))) AS VARCHAR),
              CAST(greatest(3, length(CAST(94 + i - len(list_filter(shown[1:i-1], lambda x: starts_with(x, '…') AND ends_with(x, '…'))) AS VARCHAR))) AS INT), ' ') || '│ ' || l END), chr(10)) END) AS sha FROM s""",
    ),
    "q13_result_pages": (
        _pages,
        f"""WITH {T.CHUNKS_SQL}, {TEMPLATES_SQL}, {SEARCH_SQL},
        r AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total, min(rank) OVER (PARTITION BY query_id, file) AS ff,
          CASE WHEN line_end > line THEN line || '-' || line_end ELSE CAST(line AS VARCHAR) END AS rng,
          lpad(CAST(line AS VARCHAR), CAST(greatest(3, length(CAST(line AS VARCHAR))) AS INT), ' ') || '│ ' || body AS snip FROM ranked)
        SELECT query_id, sha256(CASE WHEN any_value(total) >= 5 THEN
          string_agg(CASE WHEN rank = ff THEN substr(file, 7) || chr(10) ELSE '' END || '  ' || type || ' ' || name || ' @ ' || rng
            || chr(10) || '  ' || snip, chr(10) ORDER BY ff, rank)
          ELSE string_agg(type || ' ' || name || ' @ ' || substr(file, 7) || ':' || rng || chr(10) || snip, chr(10) || chr(10) ORDER BY rank)
          END) AS sha FROM r GROUP BY query_id""",
    ),
    "q14_search_snippets": (
        _snippet_search,
        f"""WITH {T.CHUNKS_SQL}, {templates_sql(filters=False, n=10, scopes=dict(SCOPES))}, {SEARCH_SQL},
        asked(tid, q) AS (VALUES {", ".join(f"({i}, '{q}')" for i, q, _ in TEMPLATES)}),
        r AS (SELECT ranked.*, a.q, count(*) OVER (PARTITION BY query_id) AS total,
          min(rank) OVER (PARTITION BY query_id, file) AS ff,
          CASE WHEN line_end > line THEN line || '-' || line_end ELSE CAST(line AS VARCHAR) END AS rng
          FROM ranked JOIN asked a ON a.tid = CAST(string_split(query_id, ':')[2] AS INT))
        SELECT query_id, '// index search: "' || any_value(q) || '"' || chr(10) || CASE WHEN any_value(total) >= 5 THEN
          string_agg(CASE WHEN rank = ff THEN substr(file, 7) || chr(10) ELSE '' END || '  ' || type || ' ' || name || ' @ ' || rng,
            chr(10) ORDER BY ff, rank)
          ELSE string_agg(type || ' ' || name || ' @ ' || substr(file, 7) || ':' || rng, chr(10) || chr(10) ORDER BY rank) END AS text,
          CAST(floor((length(any_value(q)) * 10 + 2) / 4.0) AS BIGINT) AS tokens_saved
        FROM r GROUP BY query_id""",
    ),
    "q15_files_by_glob": (
        lambda s, d: Q.files_matching(T.text_chunks(s, d), "/work/SRC?/*/en/**_%.md")
        .unionByName(Q.files_matching(T.text_chunks(s, d), "/work/SRC?/**/d?1*")),
        f"WITH {T.CHUNKS_SQL} SELECT DISTINCT file FROM chunks WHERE regexp_matches(lower(file), '^/work/src./.*/d.1.*$')",
    ),
}
