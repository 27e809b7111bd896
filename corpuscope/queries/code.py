"""Registered queries over source text: symbols, edges, listings and incremental maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuscope import dims
from corpuscope.functions import columns as C
from corpuscope.operators import corpus, graph, incremental, index_stats
from corpuscope.operators import rendering as R
from corpuscope.operators import symbols as X
from corpuscope.plans import indexing
from corpuscope.session import cut_lineage, ensure_checkpoint_dir, stored
from corpuscope.sources.sinks import IndexStore
from corpuscope.sources import tables as T
from corpuscope.streaming import changes

LONG = ("line", "line_end")


def _code_chunks(spark, folder):
    return X.extract_chunks(T.code_corpus(spark, folder))


def _chunk_rows(spark, folder):
    out = _code_chunks(spark, folder)
    return out.select(
        "project_id", "file", "name", "type", *[F.col(c).cast("bigint").alias(c) for c in LONG], "content",
        F.sha2("body", 256).alias("body_sha"),
    )


def _edge_tables(spark, folder):
    """Edges from a stored chunk table, as the index job derives them: the corpus is parsed once."""
    corpus_rows = T.code_corpus(spark, folder)
    chunks = cut_lineage(X.corpus_chunks(corpus_rows))
    return graph.EdgeTables.of(chunks, corpus_rows)


def _edges(spark, folder):
    return _edge_tables(spark, folder).expand()


def _pages(spark, folder):
    """Web pages as .html files."""
    return T.spread(T.table(spark, folder, "pages"), "page_id").select(
        F.concat(F.lit("w"), F.col("page_id") % 5).alias("project_id"),
        F.concat(F.lit("/web/p"), "page_id", F.lit(".html")).alias("file"),
        F.octet_length("html").cast("bigint").alias("length"),
        F.replace("html", F.lit("<article>"), F.concat(F.lit('<Article id="a'), "page_id", F.lit('">'))).alias("content"),
    )


def _document_code(spark, folder):
    """Every document as a source file: a function for each line, named after its first word, calling one named after its last word.

    Files are as long as the documents, and frequent words are defined and called in very many files.
    """
    body = F.transform(C.lines_of(F.translate("text", "\r", " ")), lambda t: F.concat(
        F.lit("function f_"), F.regexp_extract(t, "[A-Za-z]+", 0), F.lit("(q) {\n  // "), t, F.lit("\n  f_"),
        F.regexp_extract(t, "([A-Za-z]+)[^A-Za-z]*$", 1), F.lit("(q)\n}")))
    doc = F.col("doc_id")
    content = F.array_join(body, "\n")
    return T.spread(T.table(spark, folder, "documents"), "doc_id").select(
        F.concat(F.lit("d"), doc % 3).alias("project_id"), F.concat(F.lit("/d"), doc % 3, F.lit("/f"), doc, F.lit(".js")).alias("file"),
        F.octet_length(content).cast("bigint").alias("length"), content.alias("content"))


def _document_chunks(spark, folder):
    out = X.corpus_chunks(_document_code(spark, folder))
    return out.select("project_id", "file", "name", "type", *[F.col(c).cast("bigint").alias(c) for c in LONG], F.sha2("body", 256).alias("body_sha"))


def _document_edges(spark, folder):
    """Edges per project, and the ten files that most others refer to; no edge is made as a row."""
    corpus_rows = _document_code(spark, folder)
    chunks = stored(X.corpus_chunks(corpus_rows))
    tables = graph.EdgeTables.of(chunks, corpus_rows).stored()
    edges = tables.counts().select(F.lit("edges").alias("what"), "project_id", F.lit("").alias("file"), "n")
    return edges.unionByName(tables.fan_in().select(F.lit("fan_in").alias("what"), "project_id", F.col("target_file").alias("file"), "n"))


DOCUMENT_SQL = r"""
src AS (SELECT 'd' || doc_id % 3 AS project_id, '/d' || doc_id % 3 || '/f' || doc_id || '.js' AS file,
    string_split(replace(text, chr(13), ' '), chr(10)) AS parts FROM documents),
ln AS (SELECT project_id, file, i, parts[i] AS t, 'f_' || regexp_extract(parts[i], '[A-Za-z]+') AS w1,
    'f_' || regexp_extract(parts[i], '([A-Za-z]+)[^A-Za-z]*$', 1) AS w2 FROM src, unnest(range(1, len(parts) + 1)) u(i)),
refs AS (SELECT project_id, file, w AS name, count(*) AS r FROM (
    SELECT project_id, file, w1 AS w FROM ln UNION ALL SELECT project_id, file, w2 FROM ln) GROUP BY 1, 2, 3),
defs AS (SELECT project_id, file, w1 AS name, count(*) AS d FROM ln GROUP BY 1, 2, 3)"""


FORMS = (
    "import * as ns{k} from './x'\nimport 'side{k}'\nexport { a{k}, b }\nexport * from './y'\nexport default thing{k}\n@Dec{k}(1)\n"
    "export type T{k} = { x: number };\ntype U{k} =\n  | 'a'\n  | 'b';\nexport enum E{k} {\n  A,\n  B\n}"
)
FORM_CHUNKS = (
    ("import", "ns{k}", 1, 1), ("import", "side{k}", 2, 2), ("export", "a{k}", 3, 3), ("export", "*", 4, 4), ("export", "thing{k}", 5, 5),
    ("decorator", "Dec{k}", 6, 6), ("type", "T{k}", 7, 7), ("export", "T{k}", 7, 7), ("type", "U{k}", 8, 10), ("enum", "E{k}", 11, 14),
    ("export", "E{k}", 11, 11),
)


def _forms(spark, folder):
    """Type aliases, enums, decorators and the rarer import and export forms, one file per part."""
    k = F.col("p_partkey")
    files = T.table(spark, folder, "part").select(
        F.lit("f").alias("project_id"), F.concat(F.lit("/f/p"), k, F.lit(".ts")).alias("file"),
        F.replace(F.lit(FORMS), F.lit("{k}"), k.cast("string")).alias("content"))
    return X.corpus_chunks(files).select("file", "type", "name", *[F.col(c).cast("bigint").alias(c) for c in LONG])


def _config(spark, folder):
    """Whole documents as JSON, YAML and TOML: every line is the value of a key."""
    doc = F.col("doc_id")
    lines = C.lines_of("text")
    entry = (
        F.when(doc % 3 == 0, F.transform(lines, lambda t, i: F.concat(F.lit('  "k'), i, F.lit('": "'), F.translate(t, '"', "'"), F.lit('",'))))
        .when(doc % 3 == 1, F.transform(lines, lambda t, i: F.concat(F.lit("k"), i, F.lit(": '"), F.translate(t, '"', "'"), F.lit("'"))))
        .otherwise(F.transform(lines, lambda t, i: F.concat(F.lit("[k"), i, F.lit(".v]\nv = '"), F.translate(t, '"', "'"), F.lit("'"))))
    )
    files = T.table(spark, folder, "documents").select(
        F.col("source").alias("project_id"),
        F.concat(F.lit("/c/d"), doc, F.when(doc % 3 == 0, ".json").when(doc % 3 == 1, ".yaml").otherwise(".toml")).alias("file"),
        F.array_join(entry, "\n").alias("content"))
    out = X.flat_chunks(files.withColumn("lang", C.language("file")))
    return out.select("file", "type", "name", F.col("line").cast("bigint").alias("line"))


def _markdown(spark, folder):
    """Documents as markdown files, every fourth line break opening a heading."""
    doc = F.col("doc_id")
    text = F.regexp_replace("text", r"\n(\S+ \S)", "\n## $1")
    return T.spread(T.table(spark, folder, "documents"), "doc_id").select(
        "source", F.concat(F.lit("/md/d"), doc, F.lit(".md")).alias("file"),
        F.concat(F.lit("p"), doc % 7).alias("project_id"), F.concat(F.lit("# T"), doc, F.lit("\n\n"), text).alias("content"),
    )


def _inline(spark, folder):
    out = X.inline_chunks(_pages(spark, folder).withColumn("lang", C.language("file")))
    return out.select("file", "name", F.col("line").cast("bigint").alias("line"), "content")


def _headings(spark, folder):
    out = X.flat_chunks(_markdown(spark, folder).withColumn("lang", C.language("file")))
    return out.select("file", "name", F.col("line").cast("bigint").alias("line"), "content")


def _braces(spark, folder):
    counts = X.brace_counts("content", C.language("file") == "rust")
    return T.code_corpus(spark, folder).select(
        "file", F.posexplode(counts).alias("pos", "c")
    ).filter((F.col("c.open") > 0) | (F.col("c.close") > 0)).select(
        "file", (F.col("pos") + 1).cast("bigint").alias("line"), F.col("c.open").cast("bigint").alias("n_open"),
        F.col("c.close").cast("bigint").alias("n_close"),
    )


def _sinks(spark, folder):
    """Each chunk inserted twice: the sink keeps one."""
    code = T.code_corpus(spark, folder)
    partitions = X.file_partitions(code)
    twice = X.extract_chunks(code, partitions)
    kept = X.dedupe_chunks(twice.unionByName(twice), partitions)
    return kept.groupBy("project_id", "type").agg(F.count(F.lit(1)).alias("n"))


def _targets(spark, folder):
    """Related symbols are asked for every part; those of TypeScript files exist."""
    k = F.col("p_partkey")
    return T.table(spark, folder, "part").select(
        F.concat(F.lit("c"), k % 3).alias("project_id"),
        F.concat(F.lit("s"), k % 2, F.lit("/p"), k, F.lit(".ts:fn"), k).alias("ref"),
        F.concat(F.lit("/repo/c"), k % 3).alias("root"),
    )


def _parsed_refs(spark, folder):
    return graph.parse_symbol_refs(_targets(spark, folder), T.code_corpus(spark, folder), F.col("root"))


def _related(spark, folder):
    out = _edge_tables(spark, folder).related(_parsed_refs(spark, folder), ["ref"])
    return out.select("ref", "file", "symbol", "kind", "direction", "n")


def _impact_files(spark, folder):
    return T.code_corpus(spark, folder).select("project_id", "file")


def _impacted(spark, folder):
    return _edge_tables(spark, folder).impacted(_impact_files(spark, folder))


RELATED_SQL = """rel AS (
  SELECT 's' || k % 2 || '/p' || k || '.ts:fn' || k AS ref, e.target_file AS file, e.target_symbol AS symbol, e.kind, 'out' AS direction, n
  FROM code c JOIN code_edges e ON e.source_file = c.file AND e.source_symbol = 'fn' || c.k WHERE pos = 0
  UNION ALL
  SELECT 's' || k % 2 || '/p' || k || '.ts:fn' || k, e.source_file, e.source_symbol, e.kind, 'in', n
  FROM code c JOIN code_edges e ON e.target_file = c.file AND e.target_symbol = 'fn' || c.k WHERE pos = 0),
imp AS (SELECT e.project_id, target_file AS file, source_file AS dependent, kind, source_symbol AS symbol, n
  FROM code_edges e JOIN code c ON c.file = e.target_file)"""


def _previous(spark, folder):
    """An earlier snapshot: a fifth of the files is new since, a seventh has changed."""
    doc = F.col("doc_id")
    return T.files(spark, folder).filter(doc % 5 != 0).select(
        "project_id", "file", "doc_id",
        F.when(doc % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"),
    )


def _current(spark, folder):
    return T.files(spark, folder).filter(F.col("doc_id") % 11 != 3)


def _changes(spark, folder):
    return incremental.detect_changes(
        incremental.hash_files(_current(spark, folder)), incremental.hash_files(_previous(spark, folder))
    )


CHANGES_SQL = f"""{T.FILES_SQL},
cur AS (SELECT project_id, file, sha256(content) AS hash FROM files WHERE doc_id % 11 <> 3),
prev AS (SELECT project_id, file, sha256(CASE WHEN doc_id % 7 = 0 THEN content || 'x' ELSE content END) AS hash
  FROM files WHERE doc_id % 5 <> 0),
changes AS (SELECT coalesce(c.project_id, p.project_id) AS project_id, coalesce(c.file, p.file) AS file,
  CASE WHEN p.file IS NULL THEN 'add' WHEN c.file IS NULL THEN 'delete' WHEN c.hash <> p.hash THEN 'change'
    ELSE 'unchanged' END AS status FROM cur c FULL JOIN prev p ON p.file = c.file AND p.project_id = c.project_id)"""


def _line_table(files):
    return files.select("project_id", "file", F.posexplode(C.lines_of("content")).alias("line", "text"))


def _replaced(spark, folder):
    """Line tables replaced by file: what an incremental run leaves behind equals a full run."""
    changed = incremental.touched(_changes(spark, folder))
    fresh = _line_table(_current(spark, folder).join(changed, ["project_id", "file"], "left_semi"))
    out = incremental.replace_by_file(_line_table(_previous(spark, folder)), fresh, changed)
    return out.groupBy("project_id", "file").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars")
    )


def _stored_index(spark, folder):
    """The index store after a life of its own: projects indexed one after another from an earlier state, the changes since then,
    a retry, a full run of one project, deletions. Its chunks and edges are those of the last state.

    Earlier, a fifth of the files was missing and a seventh was different; in the end a thirteenth is gone.
    """
    number = F.regexp_extract("file", r"/p(\d+)\.", 1).cast("bigint")
    now = T.code_corpus(spark, folder).withColumn("k", number)
    old = now.filter("k % 5 <> 0").withColumn(
        "content", F.when(F.col("k") % 7 == 0, F.concat("content", F.lit("\n// old"))).otherwise(F.col("content")))
    store = IndexStore(spark, f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}")
    roots = [(f"c{i}", f"/repo/c{i}") for i in range(3)]

    def full(files, chosen):
        names = spark.createDataFrame(chosen, "project_id string, path string")
        indexing.index(store, files.join(names.select("project_id"), "project_id", "left_semi"), names, ts="2024-01-01 00:00:00")

    for root in roots:
        full(old, [root])
    changed = now.filter("k % 5 = 0 or k % 7 = 0 or k % 11 = 0")
    for _ in range(2):  # the second time is a retry
        indexing.update(store, changed, None, "changes")
    full(now, roots[:1])
    indexing.update(store, now.limit(0), now.filter("k % 13 = 0").select("project_id", "file"))
    chunks = store.chunks().select(
        F.lit("chunk").alias("what"), "project_id", "file", "name", "type", F.col("line").cast("string").alias("place"),
        F.sha2("body", 256).alias("detail"), F.lit(1).cast("bigint").alias("n"))
    edges = store.edges().select(F.lit("edge"), "project_id", "source_file", "source_symbol", "kind", "target_file", "target_symbol", "n")
    return chunks.union(edges)


def _full_and_stream(spark, folder):
    """Full runs and the batches of a file-change stream take turns on one store; what counts is the state each left last.

    The stream indexes an earlier state of one project; a full run of all follows, without every thirteenth file; the stream goes on
    with changes, additions and deletions; a full run closes that for one project; the stream deletes again, then repeats that batch.
    """
    now = T.code_corpus(spark, folder).withColumn("k", F.regexp_extract("file", r"/p(\d+)\.", 1).cast("bigint"))
    store = IndexStore(spark, f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}")
    names = [(f"c{i}", f"/repo/c{i}") for i in range(3)]
    third = now.withColumn("content", F.concat("content", F.lit("\n// third")))

    def changed(number, keys, disk):
        changes.index_batches(store, lambda asked: disk.join(asked, ["project_id", "file"], "left_semi"), "watch")(keys.select("project_id", "file"), number)

    def full(files, chosen):
        indexing.index(store, files, spark.createDataFrame(chosen, "project_id string, path string"), ts="2024-01-01 00:00:00")

    changed(0, now.filter("project_id = 'c0'"), third)
    full(now.filter("k % 13 <> 0"), names)
    changed(1, now.filter("k % 11 = 0 or k % 17 = 0"), third.filter("k % 17 <> 0"))
    full(now.filter("project_id = 'c1'"), names[1:2])
    for _ in range(2):
        changed(2, now.filter("k % 19 = 0"), now.limit(0))
    chunks = store.chunks().groupBy("project_id", "file").agg(F.count("*").alias("chunks"))
    return store.hashes().join(chunks, ["project_id", "file"], "left")


def _predicates(spark, folder):
    f = T.files(spark, folder)
    return f.select(
        "file", corpus.has_code_extension("file").alias("code"), corpus.in_ignored_dir("file").alias("ignored"),
        corpus.is_generated("file").alias("generated"), corpus.is_oversized("length", 4000).alias("oversized"),
        C.language("file").alias("lang"), C.estimate_tokens("length").alias("tokens"),
        C.project_id("file").alias("pid"), C.relative_path(F.lit("/work"), "file").alias("rel"),
        C.truncate("content", 20).alias("cut"),
    )


EXT_LIST = ", ".join(f"'{e}'" for e in dims.CODE_EXTS)
LANG_CASE = " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in dims.LANG_BY_EXT.items())
PRED_SQL = f"""{T.FILES_SQL},
pred AS (SELECT *, regexp_extract(regexp_extract(file, '[^/]*$'), '^.+(\\.[^.]*)$', 1) AS ext,
  regexp_matches(file, '/(node_modules|build|\\.git)/') AS ignored,
  regexp_matches(file, '/(node_modules|build)/') OR regexp_matches(file, '\\.min\\.[^/]*$') AS generated FROM files),
kept AS (SELECT * FROM pred WHERE ext IN ({EXT_LIST}) AND NOT ignored AND NOT generated AND length <= 1048576)"""

SENSITIVE = ("/.env", "/.env.production", "/.aws/credentials", "/.ssh/id_rsa", "/a/server.pem", "/k/server.key",
             "/.git/config", "/x/AWS_CREDENTIALS.json", "/cdk.context.json", "/cdk.out/m.json", "/environment.ts", "/a.keys")


def _sensitive(spark, folder):
    """Every document path, given one of the sensitive-looking tails."""
    f = T.files(spark, folder)
    path = F.concat("file", T._pick(SENSITIVE, F.col("doc_id")))
    return f.select(path.alias("path")).filter(~corpus.is_sensitive("path"))


def _capped(spark, folder):
    return corpus.scan_corpus(T.files(spark, folder), max_files=5).select("project_id", "file")


MARKED = (".git/config", "package.json", "src/a.ts", "App.xcodeproj/project", "go.mod", "README.md", "deep/go.mod")


def _listing(spark, folder):
    """A listing of many sibling directories, some with project markers."""
    k = F.col("p_partkey")
    name = F.when(k % 17 == 0, ".hidden").when(k % 19 == 0, "vendor").otherwise(F.concat(F.lit("proj"), k % 90))
    return T.table(spark, folder, "part").select(
        F.concat(F.lit("/root/all/"), name, F.lit("/"), T._pick(MARKED, (k / 90).cast("bigint") * 5 + k % 90)).alias("path")
    )


def _upserted(spark, folder):
    """Meta values written by events: the latest write per key stays."""
    ev = T.table(spark, folder, "events").select(
        F.concat(F.lit("p"), F.col("user_id") % 10).alias("project_id"), F.get_json_object("props", "$.k").alias("key"),
        F.concat(F.lit("v"), "event_id").alias("value"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
    )
    old, new = ev.filter(F.col("event_id") % 2 == 0).drop("event_id"), ev.filter(F.col("event_id") % 2 == 1).drop("event_id")
    return incremental.upsert(old, new, ["project_id", "key"]).select("project_id", "key", "value")


def _registry(spark, folder):
    old = T.projects(spark, folder).filter(F.length("name") < 3).withColumns(
        {"chunks": F.lit(0).cast("bigint"), "files": F.lit(0).cast("bigint")}
    ).withColumn("id", C.project_id("path"))
    seen = T.projects(spark, folder)
    merged = corpus.merge_projects(old, seen.select("path", "last_seen"))
    counts = seen.select(C.project_id("path").alias("project_id"), F.length("path").cast("bigint").alias("chunks"), F.lit(2).cast("bigint").alias("files"))
    return corpus.list_projects(corpus.update_project_counts(merged, counts)).select(
        "id", "path", "name", F.unix_micros("last_seen").alias("last_seen"), "chunks", "files")


def _resolved(spark, folder):
    k = F.col("p_partkey")
    names = T.table(spark, folder, "part").select(
        F.concat(F.lit("c"), k % 3).alias("project_id"), F.concat(F.lit("s"), k % 2, F.lit("/p"), k).alias("name"),
    )
    return graph.resolve_names(
        names.withColumn("root", F.concat(F.lit("/repo/"), "project_id")), T.code_corpus(spark, folder), F.col("root")
    ).select("name", "resolved")


def _paths(spark, folder):
    raw = F.concat("file", F.lit("/.././x//y/../"), F.col("doc_id") % 3, F.lit("/./z.ts"))
    return T.files(spark, folder).select("file", graph.normalize_path(raw).alias("path"))


def _indexed(spark, folder):
    """Whole index of the code corpus: chunks, hashed files and edges per project."""
    kept = corpus.scan_corpus(T.code_corpus(spark, folder), max_files=None)
    chunks = cut_lineage(X.corpus_chunks(kept))
    return index_stats.index_counts(chunks, incremental.hash_files(kept), graph.EdgeTables.of(chunks, kept).counts())


QUERIES = {
    "d6_index_counts": (
        _indexed,
        f"""WITH {T.CODE_SQL}, c AS (SELECT project_id, count(*) AS n FROM (
          SELECT DISTINCT project_id, file, name, type, line FROM code_chunks) GROUP BY 1)
        SELECT f.project_id, c.n AS chunks, f.n AS files, CAST(coalesce(e.n, 0) AS BIGINT) AS edges
        FROM (SELECT project_id, count(*) AS n FROM code GROUP BY 1) f JOIN c ON c.project_id = f.project_id
        LEFT JOIN (SELECT project_id, sum(n) AS n FROM code_edges GROUP BY 1) e ON e.project_id = f.project_id""",
    ),
    "x_symbol_chunks": (
        _chunk_rows,
        f"""WITH {T.CODE_SQL} SELECT project_id, file, name, type, CAST(line AS BIGINT) AS line,
        CAST(line_end AS BIGINT) AS line_end, content, sha256(body) AS body_sha FROM code_chunks""",
    ),
    "x_document_chunks": (
        _document_chunks,
        rf"""WITH {DOCUMENT_SQL} SELECT project_id, file, w1 AS name, 'function' AS type, CAST(i * 4 - 3 AS BIGINT) AS line, CAST(i * 4 AS BIGINT) AS line_end,
          sha256('function ' || w1 || '(q) {{' || chr(10) || '  // ' || t || chr(10) || '  ' || w2 || '(q)' || chr(10) || '}}') AS body_sha FROM ln""",
    ),
    "g8_g9_document_edges": (
        _document_edges,
        rf"""WITH {DOCUMENT_SQL},
        every AS (SELECT project_id, name, sum(r) AS r FROM refs GROUP BY 1, 2), each AS (SELECT project_id, name, sum(d) AS d FROM defs GROUP BY 1, 2),
        n AS (SELECT project_id, sum(n) AS n FROM (SELECT project_id, r * d AS n FROM every JOIN each USING (project_id, name)
          UNION ALL SELECT project_id, -r * d FROM refs JOIN defs USING (project_id, file, name)) GROUP BY 1),
        f AS (SELECT d.project_id, d.file, count(DISTINCT r.file) AS n FROM defs d JOIN refs r ON r.project_id = d.project_id AND r.name = d.name AND r.file <> d.file
          GROUP BY 1, 2)
        SELECT 'edges' AS what, project_id, '' AS file, CAST(n AS BIGINT) AS n FROM n WHERE n > 0
        UNION ALL SELECT * FROM (SELECT 'fan_in', project_id, file, n FROM f ORDER BY n DESC, project_id, file LIMIT 10)""",
    ),
    "x7_brace_counts": (
        _braces,
        rf"""WITH {T.CODE_SQL}, l AS (SELECT file, i AS line,
          regexp_replace(parts[i], '''[^'']*''|//.*|^import \{{[^}}]*\}}', '', 'g') AS t FROM (SELECT file, string_split(content, chr(10)) AS parts FROM code), unnest(range(1, len(parts) + 1)) u(i))
        SELECT file, line, length(t) - length(replace(t, '{{', '')) AS n_open,
          length(t) - length(replace(t, '}}', '')) AS n_close FROM l WHERE contains(t, '{{') OR contains(t, '}}')""",
    ),
    "x21_html_chunks": (
        _inline,
        r"""WITH l AS (SELECT '/web/p' || page_id || '.html' AS file, i AS line, ' ' || parts[i] || ' ' AS t
          FROM (SELECT page_id, string_split(replace(html, '<article>', '<Article id="a' || page_id || '">'), chr(10)) AS parts FROM pages), unnest(range(1, len(parts) + 1)) u(i)),
        m AS (SELECT file, line, unnest(regexp_extract_all(t, '<[A-Z]\w*[\s>]'))  AS hit FROM l
          UNION ALL SELECT file, line, unnest(regexp_extract_all(t, '\s((?:id|data-testid)=["''][^"'']+["''])', 1)) AS hit FROM l)
        SELECT file, line, trim(hit) AS content, CASE WHEN starts_with(hit, '<') THEN regexp_extract(hit, '<(\w+)', 1)
          ELSE regexp_extract(hit, '["'']([^"'']+)["'']', 1) END AS name FROM m""",
    ),
    "x8_x11_more_forms": (
        _forms,
        f"""SELECT '/f/p' || p_partkey || '.ts' AS file, type, replace(name, '{{k}}', CAST(p_partkey AS VARCHAR)) AS name,
        CAST(line AS BIGINT) AS line, CAST(line_end AS BIGINT) AS line_end FROM part,
        (VALUES {", ".join(f"('{t}', '{n}', {a}, {b})" for t, n, a, b in FORM_CHUNKS)}) w(type, name, line, line_end)""",
    ),
    "x22_config_keys": (
        _config,
        """WITH l AS (SELECT doc_id, i - 1 AS i FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), unnest(range(1, n + 1)) u(i))
        SELECT '/c/d' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.yaml' ELSE '.toml' END AS file, 'config' AS type,
        'k' || i || CASE WHEN doc_id % 3 = 2 THEN '.v' ELSE '' END AS name, CASE WHEN doc_id % 3 = 2 THEN 2 * i + 1 ELSE i + 1 END AS line FROM l""",
    ),
    "x24_markdown_headings": (
        _headings,
        r"""WITH d AS (SELECT '/md/d' || doc_id || '.md' AS file, '# T' || doc_id || chr(10) || chr(10) ||
          regexp_replace(text, '\n(\S+ \S)', chr(10) || '## \1', 'g') AS content FROM documents),
        l AS (SELECT file, i AS line, parts[i] AS t FROM (SELECT file, string_split(content, chr(10)) AS parts FROM d),
          unnest(range(1, len(parts) + 1)) u(i))
        SELECT file, line, regexp_replace(t, '\s+$', '') AS content, regexp_extract(t, '^#+\s+(.+)', 1) AS name
        FROM l WHERE regexp_matches(t, '^#+\s+.+')""",
    ),
    "g1_g4_edges": (
        _edges,
        f"WITH {T.CODE_SQL} SELECT * FROM code_edges",
    ),
    "g6_related": (_related, f"WITH {T.CODE_SQL}, {RELATED_SQL} SELECT * FROM rel"),
    "g7_impacted": (_impacted, f"WITH {T.CODE_SQL}, {RELATED_SQL} SELECT * FROM imp"),
    "g8_edge_count": (
        lambda s, d: graph.edge_count(_edge_tables(s, d).counts()),
        f"WITH {T.CODE_SQL} SELECT CAST(sum(n) AS BIGINT) AS edges FROM code_edges",
    ),
    "g9_fan_in": (
        lambda s, d: _edge_tables(s, d).stored().fan_in(),
        f"""WITH {T.CODE_SQL} SELECT project_id, target_file, count(DISTINCT source_file) AS n FROM code_edges
        GROUP BY 1, 2 ORDER BY n DESC, project_id, target_file LIMIT 10""",
    ),
    "g10_related_text": (
        lambda s, d: R.reference_text(_related(s, d), ["ref"]),
        f"""WITH {T.CODE_SQL}, {RELATED_SQL},
        u AS (SELECT ref, file, kind, symbol, max(direction) AS direction FROM rel GROUP BY 1, 2, 3, 4),
        l AS (SELECT ref, file, string_agg(kind || '->' || symbol || ' (' || direction || ')', ', '
          ORDER BY kind || '->' || symbol || ' (' || direction || ')') AS refs FROM u GROUP BY 1, 2)
        SELECT ref, string_agg(file || ': ' || refs, chr(10) ORDER BY file) AS text FROM l GROUP BY 1""",
    ),
    "g10_impact_text": (
        lambda s, d: R.reference_text(_impacted(s, d), ["project_id"], impact=True),
        f"""WITH {T.CODE_SQL}, {RELATED_SQL},
        l AS (SELECT project_id, dependent, string_agg(DISTINCT kind || '->' || symbol, ', '
          ORDER BY kind || '->' || symbol) AS refs FROM imp GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY dependent) AS k,
          count(*) OVER (PARTITION BY project_id) AS c FROM l)
        SELECT project_id, string_agg(dependent || ': ' || refs, chr(10) ORDER BY k) FILTER (k <= 50) ||
          CASE WHEN any_value(c) > 50 THEN chr(10) || '[... ' || (any_value(c) - 50) || ' more files with refs]' ELSE '' END AS text
        FROM r GROUP BY 1""",
    ),
    "g11_symbol_refs": (
        lambda s, d: _parsed_refs(s, d).select("ref", "file", "name"),
        f"""WITH {T.CODE_SQL} SELECT 's' || k % 2 || '/p' || k || '.ts:fn' || k AS ref, file, 'fn' || k AS name
        FROM code WHERE pos = 0""",
    ),
    "g12_resolve_names": (
        _resolved,
        f"""WITH {T.CODE_SQL} SELECT 's' || k % 2 || '/p' || k AS name, CASE WHEN pos < 10 THEN file END AS resolved
        FROM code""",
    ),
    "g5_normalize_paths": (
        _paths,
        rf"""WITH {T.FILES_SQL} SELECT file, regexp_replace(file, '/[^/]*$', '') || '/x/' || doc_id % 3 || '/z.ts' AS path FROM files""",
    ),
    "s2_s5_predicates": (
        _predicates,
        f"""WITH {PRED_SQL} SELECT file, ext IN ({EXT_LIST}) AS code, ignored, generated, length > 4000 AS oversized,
        coalesce(CASE ext {LANG_CASE} END, nullif(substr(ext, 2), ''), 'unknown') AS lang,
        CAST(floor((length + 2) / 4.0) AS BIGINT) AS tokens, substr(sha1(file), 1, 16) AS pid, substr(file, 7) AS rel,
        CASE WHEN length(content) > 20 THEN substr(content, 1, 20) || '…' ELSE content END AS cut FROM pred""",
    ),
    "s1_corpus_scan": (
        lambda s, d: corpus.scan_corpus(T.files(s, d), max_files=None).groupBy("project_id").agg(
            F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
        ),
        f"WITH {PRED_SQL} SELECT project_id, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM kept GROUP BY 1",
    ),
    "s6_file_cap": (
        _capped,
        f"""WITH {PRED_SQL} SELECT project_id, file FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY file) AS k
        FROM kept) WHERE k <= 5""",
    ),
    "s6_cap_summary": (
        lambda s, d: corpus.corpus_summary(T.files(s, d), 8),
        f"""WITH {PRED_SQL} SELECT project_id, least(count(*), 8) AS files, count(*) >= 8 AS capped FROM kept GROUP BY 1""",
    ),
    "s7_sensitive_paths": (
        _sensitive,
        f"""WITH {T.FILES_SQL} SELECT file || {T._sql_pick(SENSITIVE, 'doc_id')} AS path FROM files
        WHERE doc_id % {len(SENSITIVE)} IN (10, 11) AND NOT contains(file, '/.git/')""",
    ),
    "s9_discover_projects": (
        lambda s, d: corpus.project_roots(_listing(s, d), "/root/all", "/root/all/proj5", dims.MAX_DISCOVERED),
        f"""WITH p AS (SELECT CASE WHEN p_partkey % 17 = 0 THEN '.hidden' WHEN p_partkey % 19 = 0 THEN 'vendor'
          ELSE 'proj' || p_partkey % 90 END AS name,
          ((p_partkey // 90) * 5 + p_partkey % 90) % 7 AS m FROM part)
        SELECT '/root/all/' || name AS path FROM p WHERE name NOT IN ('.hidden', 'vendor', 'proj5') GROUP BY name
        HAVING bool_or(m IN (0, 1, 3, 4)) ORDER BY path LIMIT 50""",
    ),
    "s10_chunk_sink": (
        _sinks,
        f"""WITH {T.CODE_SQL} SELECT project_id, type, count(*) AS n FROM (
        SELECT DISTINCT project_id, file, name, type, line FROM code_chunks) GROUP BY 1, 2""",
    ),
    "s12_upsert": (
        _upserted,
        """SELECT 'p' || user_id % 10 AS project_id, json_extract_string(props, '$.k') AS key,
        arg_max('v' || event_id, (ts, event_id % 2)) AS value FROM events GROUP BY 1, 2""",
    ),
    "s14_s15_registry": (
        _registry,
        f"""WITH {T.PROJECTS_SQL} SELECT substr(sha1(path), 1, 16) AS id, path, name, epoch_us(last_seen) AS last_seen,
        CAST(length(path) AS BIGINT) AS chunks, CAST(2 AS BIGINT) AS files FROM projects WHERE NOT starts_with(path, '/tmp/')""",
    ),
    "d1_d2_changes": (
        lambda s, d: _changes(s, d).select("project_id", "file", "status"),
        f"WITH {CHANGES_SQL} SELECT * FROM changes",
    ),
    "d3_replace_by_file": (
        _replaced,
        f"""WITH {CHANGES_SQL} SELECT project_id, file, CAST(len(string_split(content, chr(10))) AS BIGINT) AS lines,
        CAST(length(replace(content, chr(10), '')) AS BIGINT) AS chars FROM files WHERE doc_id % 11 <> 3""",
    ),
    "d4_d6_r3_stored_index": (
        _stored_index,
        f"""WITH {T.CODE_SQL}, final AS (SELECT * FROM code WHERE k % 13 <> 0),
        edges AS (SELECT e.* FROM code_edges e JOIN final s ON s.file = e.source_file
          WHERE e.kind = 'import' OR e.target_file IN (SELECT file FROM final)),
        kept AS (SELECT project_id, source_file, source_symbol, kind,
          CASE WHEN kind = 'import' AND target_file NOT IN (SELECT file FROM final) THEN regexp_replace(target_file, '\\.js$', '.ts')
            ELSE target_file END AS target_file, target_symbol, n FROM edges)
        SELECT DISTINCT 'chunk' AS what, c.project_id, c.file, c.name, c.type, CAST(c.line AS VARCHAR) AS place, sha256(c.body) AS detail, CAST(1 AS BIGINT) AS n
        FROM code_chunks c JOIN final f ON f.file = c.file
        UNION ALL SELECT 'edge', project_id, source_file, source_symbol, kind, target_file, target_symbol, n FROM kept""",
    ),
    "d6_r3_full_and_stream": (
        _full_and_stream,
        f"""WITH {T.CODE_SQL}, final AS (
          SELECT project_id, file, k, CASE WHEN project_id <> 'c1' AND k % 11 = 0 THEN content || chr(10) || '// third' ELSE content END AS content
          FROM code WHERE k % 19 <> 0 AND (project_id = 'c1' OR (k % 17 <> 0 AND (k % 13 <> 0 OR k % 11 = 0)))),
        n AS (SELECT file, count(*) AS chunks FROM (SELECT DISTINCT file, name, type, line FROM code_chunks) GROUP BY file)
        SELECT project_id, file, sha256(content) AS hash, chunks FROM final LEFT JOIN n USING (file)""",
    ),
    "d5_prune_indexed": (
        lambda s, d: incremental.prune_indexed(
            T.files(s, d).select("project_id", "file"), T.text_chunks(s, d)
        ),
        f"""WITH {T.CHUNKS_SQL} SELECT project_id, file FROM files f WHERE EXISTS (SELECT 1 FROM chunks c
        WHERE c.project_id = f.project_id AND c.file = f.file)""",
    ),
}
