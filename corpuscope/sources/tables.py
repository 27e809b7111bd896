"""The jobs' input tables, derived from the shared parquet tables.

The shared tables hold prose, web pages, conversations and an event stream. These functions map
them, row by row, to the engine's own schemas; nothing is sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import columns as C

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a scan that feeds heavy per-row work over ``spark.corpuscope.spread`` tasks.

    A small table may be one file with one row group, hence one task; local sessions set the number of cores. Without the
    setting, as on a cluster, the splits of the scan stay and nothing moves.
    """
    tasks = int(df.sparkSession.conf.get("spark.corpuscope.spread", "0"))
    return df.repartition(tasks, *keys) if tasks else df


def usage_events(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    eid, kind = F.col("event_id"), F.col("event_type")
    return table(spark, folder, "events").select(
        F.concat(F.lit("p"), F.col("user_id")).alias("project_id"),
        eid.alias("id"),
        F.when(kind == "click", "search")
        .when(kind == "view", F.when(eid % 3 == 0, "cache_hit").otherwise("file_read"))
        .when(kind == "purchase", "index_substitute")
        .when(kind == "signup", F.when(eid % 4 == 0, "semantic_compression").otherwise("compression"))
        .otherwise(F.when(eid % 5 == 0, "turn_savings").otherwise("search_savings"))
        .alias("event_type"),
        F.floor("value").alias("tokens_saved"),
        F.lit(0).cast("bigint").alias("tokens_used"),
        F.when(eid % 2 == 0, F.concat(F.lit('{"query":"q'), k, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"path":"src/f'), k, F.lit('.ts"}')))
        .alias("meta"),
        F.when(eid % 97 != 0, F.col("ts").cast("timestamp")).alias("ts"),
    )


USAGE_SQL = """
usage AS (
  SELECT 'p' || user_id AS project_id, event_id AS id,
    CASE event_type
      WHEN 'click' THEN 'search'
      WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'cache_hit' ELSE 'file_read' END
      WHEN 'purchase' THEN 'index_substitute'
      WHEN 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 'semantic_compression' ELSE 'compression' END
      ELSE CASE WHEN event_id % 5 = 0 THEN 'turn_savings' ELSE 'search_savings' END
    END AS event_type,
    CAST(floor(value) AS BIGINT) AS tokens_saved, CAST(0 AS BIGINT) AS tokens_used,
    CASE WHEN event_id % 2 = 0 THEN 'q' || json_extract_string(props, '$.k') END AS m_query,
    CASE WHEN event_id % 2 <> 0 THEN 'src/f' || json_extract_string(props, '$.k') || '.ts' END AS m_path,
    CASE WHEN event_id % 97 <> 0 THEN ts END AS ts
  FROM events)
"""


def projects(spark: SparkSession, folder: str) -> DataFrame:
    """Registry: one project per event user, last seen at the user's latest event."""
    path = F.concat(F.when(F.col("user_id") % 7 == 0, "/tmp/u").otherwise("/home/u"), F.col("user_id"))
    return (
        table(spark, folder, "events")
        .groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last_seen"))
        .select(
            F.concat(F.lit("p"), F.col("user_id")).alias("id"), path.alias("path"),
            C.project_name(path).alias("name"), "last_seen",
        )
    )


PROJECTS_SQL = """
projects AS (
  SELECT 'p' || user_id AS id,
    CASE WHEN user_id % 7 = 0 THEN '/tmp/u' ELSE '/home/u' END || user_id AS path,
    'u' || user_id AS name, max(ts) AS last_seen
  FROM events GROUP BY user_id)
"""

# Extensions given to documents, by doc_id modulo the list length.
DOC_EXTS = (
    ".py", ".js", ".ts", ".go", ".rs", ".java", ".rb", ".md", ".json", ".sql", ".txt",
    ".min.js", ".css", ".html", ".lock", ".yaml",
)
DOC_DIRS = ("src", "lib", "docs", "node_modules", "app/build", "src/core", "tests", ".git", "pkg")


def _pick(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(C.literal_array(values), (key % len(values)).cast("int") + 1)


def _sql_pick(values: tuple[str, ...], key: str) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"([{items}])[({key}) % {len(values)} + 1]"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """A corpus listing: one file per document."""
    doc = F.col("doc_id")
    path = F.concat(
        F.lit("/work/"), F.col("source"), F.lit("/"), _pick(DOC_DIRS, doc), F.lit("/"),
        F.col("lang"), F.lit("/d"), doc, _pick(DOC_EXTS, doc),
    )
    return spread(table(spark, folder, "documents"), "doc_id").select(
        F.concat(F.lit("p"), F.substring("source", 4, 9)).alias("project_id"),
        path.alias("file"),
        F.octet_length("text").cast("bigint").alias("length"),
        F.col("text").alias("content"),
        "doc_id",
    )


FILES_SQL = f"""
files AS (
  SELECT 'p' || substr(source, 4) AS project_id,
    '/work/' || source || '/' || {_sql_pick(DOC_DIRS, 'doc_id')} || '/' || lang || '/d' || doc_id
      || {_sql_pick(DOC_EXTS, 'doc_id')} AS file,
    CAST(octet_length(encode(text)) AS BIGINT) AS length, text AS content, doc_id
  FROM documents)
"""

TEXT_TYPES = ("function", "class", "heading", "config", "import")


def text_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """One chunk per non-blank document line: the searchable text of the corpus.

    Files keep their own project; the name is the line's first word.
    """
    base = files(spark, folder).withColumn("lang", C.language("file"))
    text = F.col("body")
    return (
        base.select("project_id", "file", "lang", F.posexplode(C.lines_of("content")).alias("pos", "body"))
        .filter(text.rlike(r"[^ \t\r]"))
        .select(
            "project_id",
            F.concat_ws(":", "file", F.col("pos") + 1).alias("id"),
            "file",
            F.regexp_extract(text, r"([^ ]+)", 1).alias("name"),
            _pick(TEXT_TYPES, F.col("pos")).alias("type"),
            (F.col("pos") + 1).cast("int").alias("line"),
            (F.col("pos") + 1 + F.col("pos") % 3).cast("int").alias("line_end"),
            C.truncate("body").alias("content"),
            "body",
            "lang",
        )
    )


CHUNKS_SQL = f"""
{FILES_SQL},
file_lang AS (
  SELECT *, regexp_extract(regexp_extract(file, '[^/]*$'), '^.+(\\.[^.]*)$', 1) AS ext FROM files),
chunks AS (
  SELECT project_id, file, regexp_extract(body, '([^ ]+)', 1) AS name,
    {_sql_pick(TEXT_TYPES, 'pos')} AS type, pos + 1 AS line, pos + 1 + pos % 3 AS line_end,
    CASE WHEN length(body) > 200 THEN substr(body, 1, 200) || '…' ELSE body END AS content,
    body,
    CASE ext WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript'
      WHEN '.rs' THEN 'rust' WHEN '.rb' THEN 'ruby' WHEN '.md' THEN 'markdown'
      ELSE substr(ext, 2) END AS lang
  FROM (SELECT project_id, file, ext, i AS pos, parts[i + 1] AS body
        FROM (SELECT project_id, file, ext, string_split(content, chr(10)) AS parts FROM file_lang),
             unnest(range(0, len(parts))) t(i))
  WHERE regexp_matches(body, '[^ \\t\\r]'))
"""


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).select("project_id", "file", F.sha2("content", 256).alias("hash"))


OUTPUT_TOOLS = ("read", "bash", "grep", "glob", "npm", "test", "git", "ssh", "jest", "rg", "other", "pytest")


def tool_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Tool logs: every document, with escapes, stack frames, runs and test counters worked in."""
    doc = F.col("doc_id")
    text = F.col("text")
    styled = F.when(doc % 4 == 0, F.replace(text, F.lit(" the "), F.lit(" \x1b[31mthe\x1b[0m "))).otherwise(text)
    framed = F.when(doc % 3 == 1, F.replace(styled, F.lit("\n"), F.lit("\n    at "))).otherwise(styled)
    located = F.when(doc % 5 == 2, F.replace(framed, F.lit(". "), F.lit(".ts:12: "))).otherwise(framed)
    tested = F.when(
        doc % 2 == 1,
        F.replace(
            F.replace(located, F.lit(" of "), F.lit("\n3 passed, 1 failed\nTypeError: bad ")),
            F.lit(" und "), F.lit("\n2 skipped\nFAIL src/a.ts > works\n"),
        ),
    ).otherwise(located)
    output = F.concat(tested, F.expr("repeat('\\nretry in 5s', cast(doc_id % 7 as int))"))
    return spread(table(spark, folder, "documents"), "doc_id").select(
        F.concat(F.lit("c"), doc).alias("call_id"),
        F.concat(F.lit("s"), doc % 50).alias("session_id"),
        _pick(OUTPUT_TOOLS, doc).alias("tool_id"),
        F.timestamp_seconds(F.lit(1704067200) + doc * 60).alias("ts"),
        output.alias("output"),
    )


OUTPUTS_SQL = f"""
d1 AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0
    THEN replace(text, ' the ', ' ' || chr(27) || '[31mthe' || chr(27) || '[0m ') ELSE text END AS t FROM documents),
d2 AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN replace(t, chr(10), chr(10) || '    at ') ELSE t END AS t FROM d1),
d3 AS (SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN replace(t, '. ', '.ts:12: ') ELSE t END AS t FROM d2),
d4 AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN replace(
    replace(t, ' of ', chr(10) || '3 passed, 1 failed' || chr(10) || 'TypeError: bad '),
    ' und ', chr(10) || '2 skipped' || chr(10) || 'FAIL src/a.ts > works' || chr(10)) ELSE t END AS t FROM d3),
outputs AS (SELECT 'c' || doc_id AS call_id, 's' || (doc_id % 50) AS session_id,
    {_sql_pick(OUTPUT_TOOLS, 'doc_id')} AS tool_id,
    t || repeat(chr(10) || 'retry in 5s', CAST(doc_id % 7 AS INT)) AS output FROM d4)
"""


# ---------------------------------------------------------------- a code corpus out of `part`

# One source file per part: extension by p_partkey modulo 12, project modulo 3. {k} is the part,
# {t} the part it refers to (36 further on: same language, same project), {s} its folder.
CODE_EXT = (".ts", ".js", ".py", ".go", ".rs", ".java", ".rb", ".php", ".cpp", ".cs", ".css", ".sql")
CODE_TEXT = (
    "import { fn{t} } from '../s{s}/p{t}'\nexport class C{k} extends C{t} implements I{t} {\n  run{k}(a) {\n"
    "    if (a) { return fn{t}(a) }\n  }\n}\nexport function fn{k}(\n  a: string\n): string {\n  return fn{t}(a)\n}\n"
    "export interface I{k} {\n  x: string\n}",
    "const dep{t} = require('../s{s}/p{t}')\nconst fn{k} = (a) => {\n  return fn{t}(a)\n}\n"
    "class C{k} extends C{t} {\n  run{k}(a) {\n    return '}' + fn{t}(a)\n  }\n}",
    "import os\nclass C{k}(Base):\n    def run(self, a):\n        return fn{t}(a)\n\ndef fn{k}(a):\n    return fn{t}(a)",
    "package m\nimport \"fmt\"\nfunc fn{k}(a int) int {\n\treturn fn{t}(a)\n}\ntype S{k} struct {\n\tx int\n}",
    "use std::fmt;\nstruct S{k} {\n    x: i32,\n}\nimpl S{k} {\n    pub fn run(a: i32) -> i32 { fn{t}(a) }\n}",
    "import java.util.List;\npublic class C{k} {\n    @Override\n    public int run(int a) {\n"
    "        return fn{t}(a); // }\n    }\n}",
    "require 'set'\nclass C{k}\n  def run(a)\n    if a\n      fn{t}(a)\n    end\n  end\nend",
    "<?php\nfunction fn{k}($a) {\n    return fn{t}($a);\n}",
    "#include <vector>\nint fn{k}(int a) {\n    return fn{t}(a);\n}",
    "using System.Text;\npublic class C{k} {\n    public int Run(int a) { return fn{t}(a); }\n}",
    ".c{k} {\n  --v{k}: 1;\n}",
    "CREATE TABLE t{k} (\n  id INT\n);\nselect * from t{t}",
)
# What must come out, by position in CODE_EXT: type, name, line, line_end, content.
CODE_CHUNKS = (
    (0, "import", "fn{t}", 1, 1, "import { fn{t} } from '../s{s}/p{t}'"),
    (0, "class", "C{k}", 2, 6, "class C{k}"), (0, "export", "C{k}", 2, 2, "export class C{k}"),
    (0, "function", "run{k}", 3, 5, "method run{k}(a)"),
    (0, "function", "fn{k}", 7, 11, "function fn{k}(\n  a: string\n)"),
    (0, "export", "fn{k}", 7, 7, "export function fn{k}"),
    (0, "interface", "I{k}", 12, 14, "interface I{k}"), (0, "export", "I{k}", 12, 12, "export interface I{k}"),
    (1, "import", "dep{t}", 1, 1, "const dep{t} = require('../s{s}/p{t}')"),
    (1, "function", "fn{k}", 2, 4, "const fn{k} = (a) =>"), (1, "class", "C{k}", 5, 9, "class C{k}"),
    (1, "function", "run{k}", 6, 8, "method run{k}(a)"),
    (2, "import", "os", 1, 1, "import os"), (2, "class", "C{k}", 2, 5, "class C{k}(Base)"),
    (2, "function", "C{k}.run", 3, 5, "method def C{k}.run(self, a)"), (2, "function", "fn{k}", 6, 7, "def fn{k}(a)"),
    (3, "import", "fmt", 2, 2, "import \"fmt\""), (3, "function", "fn{k}", 3, 5, "func fn{k}(a int)"),
    (3, "class", "S{k}", 6, 8, "struct S{k}"),
    (4, "import", "fmt", 1, 1, "use std::fmt;"), (4, "class", "S{k}", 2, 4, "struct S{k}"),
    (4, "class", "S{k}", 5, 7, "impl S{k}"), (4, "function", "S{k}.run", 6, 6, "method fn S{k}.run(a: i32)"),
    (5, "import", "List", 1, 1, "import java.util.List;"), (5, "class", "C{k}", 2, 7, "class C{k}"),
    (5, "decorator", "Override", 3, 3, "@Override"), (5, "function", "C{k}.run", 4, 6, "method C{k}.run(int a)"),
    (6, "import", "set", 1, 1, "require 'set'"), (6, "class", "C{k}", 2, 8, "class C{k}"),
    (6, "function", "C{k}.run", 3, 7, "method def C{k}.run(a)"),
    (7, "function", "fn{k}", 2, 4, "function fn{k}($a)"),
    (8, "import", "vector", 1, 1, "#include <vector>"), (8, "function", "fn{k}", 2, 4, "fn{k}(int a)"),
    (9, "import", "Text", 1, 1, "using System.Text;"), (9, "class", "C{k}", 2, 4, "class C{k}"),
    (9, "function", "C{k}.Run", 3, 3, "method C{k}.Run(int a)"),
    (10, "selector", ".c{k}", 1, 1, ".c{k}"), (10, "selector", "--v{k}", 2, 2, "--v{k}"),
    (11, "table", "t{k}", 1, 1, "CREATE TABLE t{k}"), (11, "table", "t{t}", 4, 4, "from t{t}"),
)
# Edges per file whose part {t} exists: position, source symbol, target symbol, kind.
CODE_EDGES = (
    (0, "C{k}", "fn{t}", "call"), (0, "run{k}", "fn{t}", "call"), (0, "fn{k}", "fn{t}", "call"),
    (0, "C{k}", "C{t}", "extend"), (0, "C{k}", "I{t}", "implement"),
    (1, "C{k}", "fn{t}", "call"), (1, "run{k}", "fn{t}", "call"), (1, "fn{k}", "fn{t}", "call"),
    (1, "C{k}", "C{t}", "extend"),
    (2, "C{k}", "fn{t}", "call"), (2, "C{k}.run", "fn{t}", "call"), (2, "fn{k}", "fn{t}", "call"),
    (3, "fn{k}", "fn{t}", "call"), (7, "fn{k}", "fn{t}", "call"), (8, "fn{k}", "fn{t}", "call"),
)


def code_corpus(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    t = k + 36
    path = F.concat(F.lit("/repo/c"), k % 3, F.lit("/s"), k % 2, F.lit("/p"), k, _pick(CODE_EXT, k))
    text = F.replace(
        F.replace(F.replace(_pick(CODE_TEXT, k), F.lit("{k}"), k.cast("string")), F.lit("{t}"), t.cast("string")),
        F.lit("{s}"), (t % 2).cast("string"),
    )
    return spread(table(spark, folder, "part").select("p_partkey"), "p_partkey").select(
        F.concat(F.lit("c"), k % 3).alias("project_id"), path.alias("file"),
        F.octet_length(text).cast("bigint").alias("length"), text.alias("content"),
    )


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fill_sql(column: str) -> str:
    return f"replace(replace(replace({column}, '{{k}}', CAST(k AS VARCHAR)), '{{t}}', CAST(k + 36 AS VARCHAR)), '{{s}}', CAST((k + 36) % 2 AS VARCHAR))"


CODE_SQL = f"""
code AS (SELECT p_partkey AS k, p_partkey % 12 AS pos, 'c' || p_partkey % 3 AS project_id,
    '/repo/c' || p_partkey % 3 || '/s' || p_partkey % 2 || '/p' || p_partkey || {_sql_pick(CODE_EXT, 'p_partkey')} AS file,
    {_fill_sql('([' + ', '.join(_q(t) for t in CODE_TEXT) + '])[k % 12 + 1]')} AS content
  FROM (SELECT p_partkey, p_partkey AS k FROM part)),
want(pos, type, name, line, line_end, content) AS (VALUES
  {', '.join(f'({p}, {_q(ty)}, {_q(n)}, {a}, {b}, {_q(c)})' for p, ty, n, a, b, c in CODE_CHUNKS)}),
code_chunks AS (SELECT c.project_id, c.file, c.k, {_fill_sql('w.name')} AS name, w.type, w.line, w.line_end,
    {_fill_sql('w.content')} AS content,
    CASE WHEN w.type IN ('import','export','decorator','selector','table') THEN {_fill_sql('w.content')}
      ELSE array_to_string(string_split(c.content, chr(10))[w.line:w.line_end], chr(10)) END AS body
  FROM code c JOIN want w ON w.pos = c.pos),
want_e(pos, src, dst, kind) AS (VALUES {', '.join(f'({p}, {_q(a)}, {_q(b)}, {_q(k)})' for p, a, b, k in CODE_EDGES)}),
code_edges AS (
  SELECT c.project_id, c.file AS source_file, {_fill_sql('e.src')} AS source_symbol, o.file AS target_file,
    {_fill_sql('e.dst')} AS target_symbol, e.kind, CAST(1 AS BIGINT) AS n
  FROM code c JOIN want_e e ON e.pos = c.pos JOIN (SELECT k AS ok, file FROM code) o ON o.ok = c.k + 36
  UNION ALL
  SELECT project_id, file, CASE pos WHEN 0 THEN 'p' || (k + 36) ELSE 'dep' || (k + 36) END,
    '/repo/' || project_id || '/s' || (k + 36) % 2 || '/p' || (k + 36) ||
      CASE WHEN pos = 1 AND k + 36 IN (SELECT p_partkey FROM part) THEN '.js' ELSE '.ts' END,
    CASE pos WHEN 0 THEN 'p' || (k + 36) ELSE 'dep' || (k + 36) END, 'import', CAST(1 AS BIGINT)
  FROM code WHERE pos IN (0, 1))
"""


def tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls made by users: one per event, arguments from the event's number."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k")
    commands = (
        "cat src/f{k}.ts", "grep -n 'fn {k}' src/f{k}.ts", "git status", "git show HEAD:src/f{k}.ts",
        "git grep needle{k} lib/f{k}.go x/y{k}.go", "jq .a{k} data/{k}.json", "head -20 /etc/passwd", "npm test",
        "rg \"two words\" ../other/f{k}.rs ./in/f{k}.rs", "sed -n 1,5p /home/p/./a/../b{k}.py", "cat .env", "wc -l",
    )
    command = F.replace(_pick(commands, e), F.lit("{k}"), k)
    tools = ("read", "grep", "bash", "glob", "webfetch", "sh", "websearch", "bash", "Read", "Bash", "edit")
    tool = _pick(tools, e)
    file = F.concat(F.when(e % 3 == 0, "/home/p/").when(e % 3 == 1, "").otherwise("/etc/"), F.lit("src/f"), k, F.lit(".ts"))
    shell = tool.isin("bash", "sh", "Bash")
    args = (
        F.when(shell, F.to_json(F.struct(command.alias("command"))))
        .when(tool == "read", F.to_json(F.struct(file.alias("filePath"))))
        .when(tool == "Read", F.to_json(F.struct(F.when(e % 5 == 0, "/home/p/.ssh/id").otherwise(file).alias("file_path"))))
        .when(tool.isin("grep", "glob"), F.to_json(F.struct(F.concat(F.lit("pat"), k).alias("pattern"))))
        .when(tool == "webfetch", F.to_json(F.struct(F.concat(F.lit("https://e.org/"), k).alias("url"))))
        .otherwise(F.to_json(F.struct(F.concat(F.lit("what is "), k).alias("q"))))
    )
    return spread(table(spark, folder, "events"), "event_id").select(
        F.concat(F.lit("k"), e).alias("call_id"), F.concat(F.lit("s"), F.col("user_id")).alias("session_id"),
        F.col("ts").cast("timestamp").alias("ts"), tool.alias("tool"), args.alias("args"),
        F.lit("/home/p").alias("project_dir"), e.alias("event_id"), k.alias("k"),
    )
