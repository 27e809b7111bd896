"""Scalar functions, predicates, parsing of queries and calls on small literal tables."""

from __future__ import annotations

import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpuscope import schemas
from corpuscope.functions import columns as C
from corpuscope.operators import classify, compaction, corpus, graph, incremental, rendering, search, sessions


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_token_estimates(spark):
    got = [one(spark, C.estimate_tokens("n"), n=n) for n in (0, 10, 100, 2, 1, -9)]
    assert got == [0, 3, 25, 1, 0, 0]


@pytest.mark.parametrize("path,hidden", [
    ("/repo/.env", True), ("/repo/.env.production", True), ("/u/.aws/credentials", True), ("/u/.ssh/id_rsa", True),
    ("/r/certs/server.pem", True), ("/r/certs/server.key", True), ("/r/.git/config", True), ("/r/AWS_CREDENTIALS.json", True),
    ("/r/cdk.context.json", True), ("/r/cdk.out/manifest.json", True), ("/r/src/app.ts", False), ("/r/README.md", False),
    ("", False), (None, False),
])
def test_sensitive_paths(spark, path, hidden):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(corpus.is_sensitive("path").alias("x")).first().x is hidden


def test_corpus_listing(spark):
    rows = [
        ("p", "/w/a.ts", 10, "x"), ("p", "/w/sub/b.ts", 10, "x"), ("p", "/w/node_modules/lib.ts", 10, "x"),
        ("p", "/w/bundle.min.js", 10, "x"), ("p", "/w/big.ts", 2_000_000, "x"), ("p", "/w/pic.png", 1, "x"),
        ("p", "/w/.ts", 1, "x"),
    ]
    files = spark.createDataFrame(rows, schemas.CORPUS)
    assert {r.file for r in corpus.scan_corpus(files).collect()} == {"/w/a.ts", "/w/sub/b.ts"}
    assert [r.file for r in corpus.scan_corpus(files, max_files=1).collect()] == ["/w/a.ts"]


def test_read_corpus_from_disk(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "dist").mkdir()
    (tmp_path / "src" / "a.ts").write_text("export const é = 1\n")
    (tmp_path / "dist" / "b.ts").write_text("x")
    got = corpus.read_corpus(spark, {"p": str(tmp_path)}).collect()
    assert [(r.project_id, r.file, r.content) for r in got] == [("p", f"{tmp_path}/src/a.ts", "export const é = 1\n")]


def test_top_k_with_salt_is_exact(spark):
    df = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    from corpuscope.operators.ranking import top_k_per_group

    top = top_k_per_group(df, ["k"], [F.asc("v")], 1500, salt_by=["v"])
    assert sorted(r.v for r in top.collect()) == list(range(1500))


def test_running_total_over_one_hot_key(spark):
    from corpuscope.operators.ranking import running_total

    df = spark.range(2000).select(F.lit("hot").alias("k"), F.lit(7).alias("ts"), "id", F.lit(1).alias("v"))
    out = running_total(df, ["ts", "id"], "v", "total", ["k"], partitions=7)
    assert out.filter(F.col("total") != F.col("id") + 1).count() == 0
    assert out.count() == 2000


def test_query_parsing(spark):
    q = spark.createDataFrame([(1, "p", 'TYPE:"Function" auth "two words" x lang:TS file:src/', -1)], "query_id int, project_id string, q string, n int")
    r = search.plan_queries(q).first()
    assert (r.type_filter, r.lang_filter, r.file_filter) == ("function", "ts", "src/")
    assert r.match == ["auth", "two", "words"]
    assert r.n == 10


BM25 = [
    ("authauth", "function authauth(auth)", -1.0504876493551243),
    ("Authority", "class Authority", -0.8576985798173038),
    ("handleAuth", "function handleAuth(req)", -0.7537739949778098),
    ("validateToken", "function validateToken(token)", None), ("UserService", "class UserService", None),
    ("ab", "const ab = (x) =>", None), ("other", "type other", None), ("misc", "enum misc", None), ("misc2", "enum misc2", None),
]


@pytest.mark.parametrize("by_gram", [False, True])
def test_bm25_values(spark, by_gram):
    rows = [("p", n, f"/{i}.ts", n, "function", i, i, c, c, "typescript") for i, (n, c, _) in enumerate(BM25)]
    chunks = spark.createDataFrame(rows, schemas.CHUNKS)
    queries = spark.createDataFrame([(1, "p", "auth", 0)], "query_id int, project_id string, q string, n int")
    got = {r.name: r.score for r in search.search(chunks, queries, by_gram=by_gram).collect()}
    want = {n: s for n, _, s in BM25 if s is not None}
    assert got.keys() == want.keys()
    assert all(abs(got[n] - want[n]) < 1e-9 for n in want)


def _sample(spark):
    rows = [
        ("p", "1", "/src/auth.ts", "handleAuth", "function", 1, 3, "function handleAuth(req)", "function handleAuth(req) {\n}", "ts"),
        ("p", "2", "/src/auth.ts", "validateToken", "function", 5, 9, "function validateToken(t)", "token body", "ts"),
        ("p", "3", "/src/user.ts", "UserService", "class", 1, 20, "class UserService", "class UserService {}", "ts"),
        ("p", "4", "/src/conf.ts", "parseConfig", "function", 2, 4, "function parseConfig()", "xx", "ts"),
    ]
    return spark.createDataFrame(rows, schemas.CHUNKS)


def test_both_ways_of_searching_agree_on_repeated_chunks(spark):
    """Chunks that share file, line, type and name, repeated rows too, are hits of their own either way."""
    chunks = _sample(spark)
    chunks = chunks.unionByName(chunks).unionByName(chunks.withColumn("content", F.concat("content", F.lit(" handleAuth more"))))
    q = spark.createDataFrame([("a", "p", "handleAuth", 50), ("b", "p", "auth function", 50), ("c", "p", "zz handle", 50)],
                              "query_id string, project_id string, q string, n int")
    runs = [
        sorted((r.query_id, r.rank, r.file, r.name, round(r.score, 9)) for r in search.search(chunks, q, by_gram=g).collect())
        for g in (False, True)
    ]
    assert runs[0] == runs[1] and len(runs[0]) > 3


def test_the_scope_applies_before_the_cut(spark):
    chunks = spark.range(300).select(
        F.lit("p").alias("project_id"), F.col("id").cast("string").alias("id"),
        F.concat(F.when(F.col("id") < 250, "/w/a/").otherwise("/w/z/"), "id").alias("file"), F.lit("hit").alias("name"),
        F.lit("function").alias("type"), F.lit(1).alias("line"), F.lit(2).alias("line_end"), F.lit("hit it").alias("content"),
        F.lit("hit it").alias("body"), F.lit("go").alias("lang"))
    q = spark.createDataFrame([("a", "p", "hit", 200, "/w/z/"), ("b", "p", "hit", 200, "/w/z/299"), ("c", "p", "hit", 200, None)],
                              "query_id string, project_id string, q string, n int, scope string")
    for by_gram in (False, True):
        got = search.search(chunks, q, by_gram=by_gram, within="scope").groupBy("query_id").count().collect()
        assert {r.query_id: r["count"] for r in got} == {"a": 50, "b": 1, "c": 200}


@pytest.mark.parametrize("by_gram", [False, True])
def test_search_limits_filters_and_fallback(spark, by_gram):
    q = spark.createDataFrame(
        [(1, "p", "handleAuth", 10), (2, "p", "zzz_nonexistent", 10), (3, "p", "type:class user", 99999), (4, "p", "", 10),
         (5, "p", "to body", 10), (6, "other", "handleAuth", 10), (7, "p", "type:function user", 10)],
        "query_id int, project_id string, q string, n int",
    )
    got = {}
    for r in search.search(_sample(spark), q, by_gram=by_gram).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.name, r.score == 0))
    assert got == {1: [("handleAuth", False)], 3: [("UserService", False)], 5: [("validateToken", True)]}


def test_search_splits_large_batches(spark, monkeypatch):
    monkeypatch.setattr(search, "ARRAY_TERM_LIMIT", 2)
    monkeypatch.setattr(search, "BROADCAST_TERM_LIMIT", 3)
    q = spark.createDataFrame([(i, "p", t, 5) for i, t in enumerate(("auth", "token", "service", "config"))],
                              "query_id int, project_id string, q string, n int")
    got = {r.query_id: r.name for r in search.search(_sample(spark), q).collect()}
    assert got == {0: "handleAuth", 1: "validateToken", 2: "UserService", 3: "parseConfig"}


def test_glob(spark):
    got = {r.file for r in search.files_matching(_sample(spark), "/SRC/**u*.t?").collect()}
    assert got == {"/src/auth.ts", "/src/user.ts"}


def test_result_rendering(spark):
    rows = [
        (1, 1, "/tmp/a.ts", "foo", "function", 1, 3, "function foo() {\n  return 1\n}"),
        (1, 2, "/tmp/a.ts", "bar", "function", 5, 7, "function bar() {\n  return 2\n}"),
        (1, 3, "/tmp/b.ts", "baz", "function", 1, 1, ""),
    ]
    df = spark.createDataFrame(rows, "query_id int, rank int, file string, name string, type string, line int, line_end int, body string")
    flat = rendering.result_page(df, F.lit("/tmp")).first().text
    assert flat.startswith("function foo @ a.ts:1-3\n  1│ function foo() {\n  2│   return 1\n  3│ }\n\nfunction bar @ a.ts:5-7")
    grouped = rendering.result_page(df, F.lit("/tmp"), compact=True, grouped=True).first().text
    assert grouped == "a.ts\n  function foo @ 1-3\n  function bar @ 5-7\nb.ts\n  function baz @ 1"


def test_snippet_elision(spark):
    body = "\n".join(f"l{i}" for i in range(20))
    text = one(spark, rendering.snippet("b", F.lit(1)), b=body).split("\n")
    assert len(text) == 13
    assert text[9] == "   │ … (8 more lines) …" and text[10] == " 10│ l17"


def _compact(spark, tool, output, **options):
    df = spark.createDataFrame([(tool, output)], "tool_id string, output string")
    return compaction.compact(df, **options).first()


def test_compaction_caps(spark):
    hundred = "\n".join(f"line {i}" for i in range(100))
    assert "70 lines omitted" in _compact(spark, "bash", hundred).compacted
    assert "90 lines omitted" in _compact(spark, "read", hundred, line_overrides={"read": 10}).compacted
    assert _compact(spark, "read", "short output").compacted == "short output"
    assert _compact(spark, "read", "").compacted == ""
    long = _compact(spark, "read", "x" * 20_000)
    assert "8000 chars omitted" in long.compacted and long.compressed_len < 20_000


def test_compaction_summary(spark):
    log = "\n".join([
        "PASS src/a.test.ts", "PASS src/b.test.ts", "FAIL src/c.test.ts > should work",
        "AssertionError: expected 1 to be 2", "    at line 42", "    at line 43", "Tests: 2 passed, 1 failed",
    ])
    r = _compact(spark, "test", log, semantic=True)
    assert r.method == "semantic" and "2 passed, 1 failed" in r.compacted and "src/c.test.ts" in r.compacted
    assert "src/c.test.ts" in _compact(spark, "test", log).compacted
    assert _compact(spark, "grep", "a:1\na:2\nb:3", semantic=True).compacted == "[semantic compress] grep: 3 matches in 2 files"
    assert _compact(spark, "glob", "a\n\nb", semantic=True).compacted == "[semantic compress] 2 files"


def test_runs_and_frames(spark):
    text = "a\nb\nb\nb\n\x1b[31mc\x1b[0m\n   at x.y\n   plain"
    r = _compact(spark, "bash", text)
    assert r.compacted == "a\nb (x3)\nc\nat x.y\n   plain" and r.method == "combined"
    assert _compact(spark, "bash", text, ansi=False, stack=False, dedupe=False).compacted == text


def test_structured_responses(spark):
    df = spark.sql("""select named_struct('type','text','file',named_struct('filePath','/r','content','a\\nb','numLines',2,'startLine',1,'totalLines',9)) r,
        named_struct('stdout','long','stderr','e','interrupted',false,'isImage',false,'noOutputExpected',false) b, 'Read' tool""")
    x = df.select(compaction.rebuild_read_response("r", F.lit("[C]")).alias("r"), compaction.rebuild_shell_response("b", F.lit("s")).alias("b"),
                  compaction.response_text("tool", "r", "b").alias("t")).first()
    assert (x.r.file.content, x.r.file.numLines, x.r.file.totalLines, x.r.type) == ("[C]", 1, 9, "text")
    assert (x.b.stdout, x.b.stderr, x.t) == ("s", "e", "a\nb")
    assert one(spark, compaction.substitute_string("o", "r"), o="abc", r="wxyz") == "wxy"


P = "/Users/test/project"
CALLS = [
    ("read", {"filePath": f"{P}/src/app.ts"}, P, "read", f"{P}/src/app.ts", None),
    ("read", {"filePath": "/etc/passwd"}, P, None, None, None),
    ("grep", {"pattern": "TODO"}, P, "grep", None, "TODO"),
    ("webfetch", {"url": "https://example.com/docs"}, P, "webfetch", "https://example.com/docs", None),
    ("webfetch", {}, P, None, None, None),
    ("websearch", {"query": "plugin api"}, P, "websearch", None, "plugin api"),
    ("bash", {"command": "cat src/app.ts"}, P, "bash-read", f"{P}/src/app.ts", None),
    ("bash", {"command": "git status"}, P, None, None, None),
    ("bash", {"command": 'rg "a b" ./x/y.ts'}, P, "bash-grep", f"{P}/x/y.ts", "a b"),
    ("bash", {"command": "git diff HEAD -- src/a.ts"}, P, "bash-read", f"{P}/src/a.ts", None),
    ("bash", {"command": "cat ~/x.ts"}, P, None, None, None),
    ("custom", {}, P, None, None, None),
    ("read", {"filePath": "a.ts"}, "", None, None, None),
]


def test_call_classification(spark):
    rows = [(str(i), t, json.dumps(a), p) for i, (t, a, p, *_) in enumerate(CALLS)]
    df = spark.createDataFrame(rows, "call_id string, tool string, args string, project_dir string")
    got = {int(r.call_id): (r.kind, r.path, r.query) for r in classify.classify_calls(df).collect()}
    assert [got[i] for i in range(len(CALLS))] == [tuple(c[3:]) for c in CALLS]
    off = classify.classify_calls(df, read=False).filter("call_id = '0'").first()
    assert off.kind is None


REDUCED = [
    ("Read", {"file_path": f"{P}/src/app.ts"}, P, "read", f"{P}/src/app.ts", None),
    ("Read", {"file_path": f"{P}/.env"}, P, None, None, None), ("Read", {}, P, None, None, None),
    ("Grep", {"pattern": "x"}, P, None, None, None), ("Bash", {"command": "cat src/app.ts"}, P, "read", f"{P}/src/app.ts", None),
    ("Bash", {"command": "cat .aws/credentials"}, P, None, None, None), ("Bash", {"command": "git diff"}, P, "compress", None, "git"),
    ("Bash", {"command": "npm test"}, P, "compress", None, "npm"), ("Bash", {"command": "curl https://e.com"}, P, None, None, None),
    ("Bash", {"command": "echo hi"}, P, None, None, None), ("Read", {"file_path": "/a.ts"}, "", None, None, None),
]


def test_reduced_classification(spark):
    rows = [(str(i), t, json.dumps(a), p) for i, (t, a, p, *_) in enumerate(REDUCED)]
    df = spark.createDataFrame(rows, "call_id string, tool string, args string, project_dir string")
    got = {int(r.call_id): (r.kind, r.path, r.tool_id) for r in classify.classify_reduced(df).collect()}
    assert [got[i] for i in range(len(REDUCED))] == [tuple(c[3:]) for c in REDUCED]


def test_conversation_terms(spark):
    rows = [(1, 0, "user", "how does the authenticate function work? a b"), (1, 1, "assistant", "ignored words"),
            (2, 0, "user", "a b c d e f g h")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r.terms for r in sessions.conversation_terms(df).collect()}
    assert got == {1: ["how", "does", "the", "authenticate", "function", "work"]}


def test_edit_guard_is_per_session(spark):
    ts = datetime(2024, 1, 1)
    reads = spark.createDataFrame([("s", "/a", ts), ("t", "/a", ts)], "session_id string, path string, ts timestamp")
    edits = spark.createDataFrame([("s", "/a", ts)], "session_id string, path string, ts timestamp")
    assert [r.session_id for r in sessions.not_edited_before(reads, edits).collect()] == ["t"]


def test_upsert_and_meta(spark):
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    old = spark.createDataFrame([("p", "k", "1", t(1)), ("p", "schema_version", "3", t(1))], schemas.META)
    new = spark.createDataFrame([("p", "k", "2", t(1)), ("q", "schema_version", "x", t(1))], schemas.META)
    merged = incremental.upsert(old, new, ["project_id", "key"])
    assert incremental.meta_value(merged, "k").first().value == "2"
    assert incremental.meta_value(merged, "missing").count() == 0
    assert {r.project_id: r.version for r in incremental.schema_version(merged).collect()} == {"p": 3, "q": 0}


def test_normalize_path(spark):
    got = [one(spark, graph.normalize_path("p"), p=p) for p in ("/a/b/../c/./d", "/../x", "a/../../b", "a//b/")]
    assert got == ["/a/c/d", "/x", "../b", "a/b"]


def test_grams_of_a_long_line_take_one_pass(spark):
    """A line of 400,000 characters, in which a substring by its place would be found by counting from the start."""
    text = "é" + "ab_ c9" * 66_000
    rows = spark.createDataFrame([(text,), ("Xab",), (None,)], "t string").select(F.array_sort(F.array_distinct(search.grams(F.col("t"), 2))).alias("g"))
    start = time.monotonic()
    assert [r.g for r in rows.collect()] == [["9a", "ab", "b_", "c9"], ["ab"], []]
    assert time.monotonic() - start < 10


def test_unranked_rows_are_cut_before_they_move(spark):
    """Words of a query that has no ranked match: each task keeps the first n rows of a word."""
    chunks = spark.createDataFrame(
        [("p", str(i), f"f{i:03}", "name", "function", 1, 1, "of un", "of un", "go") for i in range(300)], schemas.CHUNKS).repartition(2)
    planned = search.plan_queries(spark.createDataFrame([("a", "p", "of un", 3)], "query_id string, project_id string, q string, n int"))
    none = planned.select("query_id").limit(0)
    rest = search._fallback(chunks, planned, none, ["lang"], True)
    assert sorted(r.file for r in rest.collect()) == ["f000", "f001", "f002"]
    assert "WindowGroupLimit" in rest._jdf.queryExecution().executedPlan().toString()
    got = search.search(chunks, spark.createDataFrame([("a", "p", "of un", 3)], "query_id string, project_id string, q string, n int"), by_gram=True)
    assert [r.file for r in got.orderBy("rank").collect()] == ["f000", "f001", "f002"]
