"""Declarations, extents, names and edges of small sources, written out by hand."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpuscope import schemas
from corpuscope.operators import graph, index_stats, search, symbols
from corpuscope.operators.symbols import dedupe_chunks, extract_chunks
from corpuscope.plans import indexing
from corpuscope.plans.tools import Workspace
from corpuscope.sources.sinks import IndexStore, append_audit, append_usage
from corpuscope.streaming import changes

# file -> (text, [(type, name, line, line_end)])
SOURCES = {
    "a.py": (
        "@app.route('/')\ndef index():\n  return 'ok'\n\nclass A(B):\n  x = 1\n\n  def m(self, a):\n    if a:\n"
        "      pass\n# note\n  async def n(self) -> int:\n    return 1\nimport os\nfrom a.b import c, d\ndef top(): pass",
        [("decorator", "app", 1, 1), ("function", "index", 2, 4), ("class", "A", 5, 10), ("function", "A.m", 8, 10),
         ("function", "A.n", 12, 13), ("import", "os", 14, 14), ("import", "c", 15, 15), ("function", "top", 16, 16)],
    ),
    "b.js": (
        "function greet(name) {\n  return `Hello } ${name}`\n}\n\nconst add = (a, b) => a + b\nclass Animal {\n"
        "  constructor(name) { this.name = name }\n  speak(x) {\n    if (x) { y() }\n  }\n}\nimport {\n a,\n b } from './x'\n"
        "export default foo\nconst f = async (q) => {\n  const o = { a: '}' } // }\n  return o\n}\n@dec(1)\nexport { z }\n",
        [("function", "greet", 1, 3), ("function", "add", 5, 5), ("class", "Animal", 6, 11), ("function", "speak", 8, 10),
         ("import", "a", 12, 12), ("export", "foo", 15, 15), ("function", "f", 16, 19), ("decorator", "dec", 20, 20),
         ("export", "z", 21, 21)],
    ),
    "c.ts": (
        "interface User {\n  name: string\n}\ntype Point = { x: number };\nenum Color { Red, Green }\n"
        "export const VERSION = '1.0'\nexport function multi(\n  a: string\n): void {\n  go()\n}\ntype Q =\n  | 'a'\n  | 'b';\n",
        [("interface", "User", 1, 3), ("type", "Point", 4, 4), ("enum", "Color", 5, 5), ("export", "VERSION", 6, 6),
         ("function", "multi", 7, 11), ("export", "multi", 7, 7), ("type", "Q", 12, 14)],
    ),
    "d.go": (
        "package x\nimport \"fmt\"\nfunc (s *S) Hello(w http.ResponseWriter, r *http.Request) {\n  w.Write()\n}\n"
        "type Config struct {\n  Port int\n}\ntype R interface\n{\n}",
        [("import", "fmt", 2, 2), ("function", "Hello", 3, 5), ("class", "Config", 6, 8), ("interface", "R", 9, 11)],
    ),
    "e.rs": (
        "use std::fmt as f;\nstruct Point {\n  x: f64,\n}\nstruct U;\nimpl Point {\n  fn new<'a>(x: &'a f64) -> Self { Self { x } }\n}\n"
        "pub mod z;\nimpl Foo for Bar {\n fn q(&self) {\n }\n}\n",
        [("import", "f", 1, 1), ("class", "Point", 2, 4), ("class", "U", 5, 5), ("class", "Point", 6, 8),
         ("function", "Point.new", 7, 7), ("export", "z", 9, 9), ("class", "Bar", 10, 13), ("function", "Bar.q", 11, 12)],
    ),
    "F.java": (
        "import java.util.List;\npublic class Service {\n  @Override\n  public String getName() { return \"na}me\"; }\n"
        "  class Inner {\n    public void x() {\n    }\n  }\n  public int after() { return 1; }\n}\n",
        [("import", "List", 1, 1), ("class", "Service", 2, 10), ("decorator", "Override", 3, 3),
         ("function", "Service.getName", 4, 4), ("class", "Inner", 5, 8), ("function", "Inner.x", 6, 7),
         ("function", "Service.after", 9, 9)],
    ),
    "g.rb": (
        "require 'set'\nmodule M\nclass K\n  include Foo\n  def run\n    if x\n      puts 1\n    end\n  end\nend\nend\ndef hi(n)\n 1\nend",
        [("import", "set", 1, 1), ("class", "M", 2, 11), ("class", "K", 3, 10), ("import", "Foo", 4, 4),
         ("function", "K.run", 5, 9), ("function", "hi", 12, 14)],
    ),
    "h.php": (
        "<?php\nuse Foo\\Bar;\nrequire 'x.php';\nclass K {\n  public function m($a) {}\n}\nfunction hello($n) {\n  return 1;\n}",
        [("import", "Foo", 2, 2), ("import", "file", 3, 3), ("class", "K", 4, 6), ("function", "K.m", 5, 5), ("function", "hello", 7, 9)],
    ),
    "i.cpp": (
        "#include <vector>\nint add(int a, int b) {\n  return a + b;\n}\nclass K {\n  int x;\npublic:\n  K() : x(0) {}\n};\n"
        "class Fwd;\nnamespace n {\n}\ntemplate <typename T> T id(T t) {\n}\n",
        [("import", "vector", 1, 1), ("function", "add", 2, 4), ("class", "K", 5, 9), ("class", "Fwd", 10, 10), ("class", "n", 11, 12)],
    ),
    "j.cs": (
        "using System.Text;\npublic class S {\n  public string GetName() { return \"n\"; }\n}\npublic record P(string N);\n",
        [("import", "Text", 1, 1), ("class", "S", 2, 4), ("function", "S.GetName", 3, 3), ("class", "P", 5, 5)],
    ),
    "k.scss": (
        ".box {\n}\n@keyframes slide {\n}\n:root {\n  --main-x: 1;\n}\n@import 'x';\n#id-1 {}",
        [("selector", ".box", 1, 1), ("selector", "@keyframes", 3, 3), ("selector", "--main-x", 6, 6), ("selector", "#id-1", 9, 9)],
    ),
    "l.html": (
        "<template id=\"one\">\n  <Foo a>\n <div\nid='two'>x</div><Bar>\n",
        [("component", "one", 1, 1), ("component", "Foo", 2, 2), ("component", "Bar", 4, 4), ("component", "two", 4, 4)],
    ),
    "m.json": ("{\n  \"name\": \"t\",\n  \"version\": \"1\"\n}", [("config", "name", 2, 2), ("config", "version", 3, 3)]),
    "n.yaml": ("key: 1\nother:\n  - a\n", [("config", "key", 1, 1), ("config", "other", 2, 2)]),
    "t.toml": ("[a.b]\nx = 1\n", [("config", "a.b", 1, 1)]),
    "o.sql": (
        "CREATE TABLE IF NOT EXISTS a.users (\n id INT);\nselect * from users\nfrom t2",
        [("table", "users", 1, 1), ("table", "users", 3, 3), ("table", "t2", 4, 4)],
    ),
    "p.md": ("# Intro\n\ntext\n\n## Details\n", [("heading", "Intro", 1, 1), ("heading", "Details", 5, 5)]),
    "q.xyz": ("class A {}", []),
    "r.py": ("", []),
}


def _corpus(spark, sources, project="p"):
    return spark.createDataFrame([(project, f, len(t), t) for f, t in sources.items()], schemas.CORPUS)


def test_declarations_of_all_languages(spark):
    rows = extract_chunks(_corpus(spark, {f: t for f, (t, _) in SOURCES.items()})).collect()
    got = {f: [] for f in SOURCES}
    for r in rows:
        got[r.file].append((r.type, r.name, r.line, r.line_end))
        text = SOURCES[r.file][0].split("\n")
        if r.type in ("class", "function", "interface", "type", "enum"):
            assert r.body == "\n".join(text[r.line - 1 : r.line_end])
    for f, (_, want) in SOURCES.items():
        assert sorted(got[f]) == sorted(want), f


def test_contents_and_languages(spark):
    rows = {(r.file, r.name): r for r in extract_chunks(_corpus(spark, {f: t for f, (t, _) in SOURCES.items()})).collect()}
    assert rows[("a.py", "A.n")].content == "method def A.n(self)-> int"
    assert rows[("b.js", "add")].content == "const add = (a, b) =>"
    assert rows[("e.rs", "Point.new")].content == "method fn Point.new(x: &'a f64)"
    assert rows[("F.java", "Override")].content == "@Override" and rows[("k.scss", ".box")].lang == "scss"
    assert rows[("a.py", "A.m")].id == "a.py:fn:A.m"


def test_block_ends_match_a_stack(spark):
    """Random nested functions against a plain bracket stack, with a 200k-character literal."""
    rng = random.Random(7)
    sources, want = {}, {}
    for n in range(40):
        lines, stack, ends, k = [], [], {}, 0
        for _ in range(rng.randint(1, 80)):
            if stack and rng.random() < 0.45:
                lines.append("}" + rng.choice(["", " // {", " /* { */"]))
                ends[stack.pop()] = len(lines)
            else:
                name = f"f{n}_{k}"
                k += 1
                lines.append(f"function {name}(a) {{" + rng.choice(["", " s('}')", ' s("{")', " // }", " if (a) { b() }"]))
                stack.append(name)
        while stack:
            lines.append("}")
            ends[stack.pop()] = len(lines)
        sources[f"/s{n}.js"], want[f"/s{n}.js"] = "\n".join(lines), ends
    sources["/long.js"] = "function big(a) {\n  return '" + "x{" * 100_000 + "'\n}\n"
    want["/long.js"] = {"big": 3}
    got: dict = {}
    for r in extract_chunks(_corpus(spark, sources)).filter("type = 'function'").collect():
        got.setdefault(r.file, {})[r.name] = r.line_end
    assert got == want


def test_duplicates_are_stored_once(spark):
    chunks = extract_chunks(_corpus(spark, {"a.ts": "function foo(a) {\n}\n"}))
    assert dedupe_chunks(chunks.unionByName(chunks)).count() == 1


def _chunk(file, name, type_, body, content=None):
    return ("p", f"{file}:{name}", file, name, type_, 1, 3, content or body, body, "typescript")


def test_edges_of_all_kinds(spark):
    chunks = spark.createDataFrame([
        _chunk("/r/a.ts", "foo", "function", "function foo() { bar(); x.bar(); bar(1) }"),
        _chunk("/r/b.ts", "bar", "function", "function bar() { return 1 }"),
        _chunk("/r/b.ts", "Base", "class", "class Base {}"),
        _chunk("/r/b.ts", "I", "interface", "interface I {}"),
        _chunk("/r/a.ts", "K", "class", "export class K extends Base implements I, J {}"),
        _chunk("/r/a.ts", "b", "import", "import b from './sub/../b'"),
        _chunk("/r/a.ts", "u", "import", "const u = require('./util')"),
        _chunk("/r/a.ts", "os", "import", "import os from 'os'"),
    ], schemas.CHUNKS)
    listing = spark.createDataFrame([("p", "/r/a.ts"), ("p", "/r/b.ts"), ("p", "/r/util/index.js")], "project_id string, file string")
    tables = graph.EdgeTables.of(chunks, listing)
    edges = tables.expand()
    got = {(r.source_symbol, r.target_file, r.target_symbol, r.kind, r.n) for r in edges.collect()}
    assert got == {
        ("foo", "/r/b.ts", "bar", "call", 2), ("K", "/r/b.ts", "Base", "extend", 1), ("K", "/r/b.ts", "I", "implement", 1),
        ("b", "/r/b.ts", "b", "import", 1), ("u", "/r/util/index.js", "u", "import", 1),
    }
    assert graph.edge_count(edges).first().edges == graph.edge_count(tables.counts()).first().edges == 6


def test_stored_edges_of_a_hot_name_grow_linearly(spark):
    """Every file defines and calls one name: stored rows follow the files, lookups and counts see all pairs."""
    def tables(n):
        chunks = spark.range(n).select(
            F.lit("p").alias("project_id"), F.lit("i").alias("id"), F.concat(F.lit("/f"), "id").alias("file"), F.lit("get").alias("name"),
            F.lit("function").alias("type"), F.lit(1).alias("line"), F.lit(1).alias("line_end"), F.lit("get").alias("content"),
            F.lit("function get() { get() }").alias("body"), F.lit("typescript").alias("lang"))
        return graph.EdgeTables.of(chunks, chunks)

    stored = [t.references.count() + t.definitions.count() + t.imports.count() for t in (tables(50), tables(100))]
    assert stored[1] == 2 * stored[0]
    assert graph.edge_count(tables(100).counts()).first().edges == tables(100).expand().agg(F.sum("n")).first()[0] == 100 * 99 * 2
    asked = spark.createDataFrame([("r", "p", "/f1", "get")], "ref string, project_id string, file string, name string")
    assert tables(100).related(asked, ["ref"]).count() == 2 * 99
    assert tables(100).impacted(asked.select("project_id", "file")).count() == 99


def test_fan_in_counts_only_files_that_may_win(spark):
    rng = random.Random(4)
    refs, defs, imports = [], [], []
    for i in range(120):
        for name in {f"n{int(rng.paretovariate(0.7)) % 90}" for _ in range(6)}:
            refs.append(("p", f"/f{i}", "s", "call", name, 1 + i % 2))
        if i % 3 == 0:
            imports.append(("p", f"/f{i}", "s", f"/f{rng.randrange(20)}.ts", 1))
    for i in range(90):
        defs += [("p", f"/f{i % 50}", f"n{i}", 1), ("q", "/f1", f"n{i}", 1)]
    tables = graph.EdgeTables(
        spark.createDataFrame(refs, "project_id string, source_file string, source_symbol string, kind string, name string, n_refs bigint"),
        spark.createDataFrame(defs, "project_id string, target_file string, name string, n_defs bigint"),
        spark.createDataFrame(imports, "project_id string, source_file string, source_symbol string, path string, n bigint"),
        spark.createDataFrame([("p", f"/f{i}") for i in range(120)], "project_id string, file string"))
    want = [tuple(r) for r in index_stats.fan_in(tables.expand(), 5).collect()]
    counted = []
    plain = graph.EdgeTables._referrers

    def watched(self, files, imported):
        counted.append(files.count())
        return plain(self, files, imported)

    graph.EdgeTables._referrers = watched
    try:
        assert [tuple(r) for r in tables.fan_in(5, 2).collect()] == want
    finally:
        graph.EdgeTables._referrers = plain
    assert counted[0] == 10 and sum(counted) < tables.fan_in_bounds()[0].count()


def test_fan_in_of_common_names_narrows_by_blocks(spark, monkeypatch):
    """Every file uses common names, so all bounds reach the k-th count; a few blocks of referring files tell most files off."""
    monkeypatch.setattr(graph, "BLOCK_FILES", 16)
    rng = random.Random(8)
    refs = [("p", f"/f{i}", "s", "call", f"n{j}", 1) for i in range(150) for j in rng.sample(range(40), 4)]
    refs += [("p", f"/f{i}", "s", "call", "hot", 1) for i in range(75)]
    # most files define names that the same files use, a few define names of different ones
    defs = [("p", f"/f{i}", "hot", 1) for i in range(150)] + [("p", f"/f{i}", f"n{j}", 1) for i in range(150) for j in rng.sample(range(40), 30 if i < 12 else 7)]
    tables = graph.EdgeTables(
        spark.createDataFrame(refs, "project_id string, source_file string, source_symbol string, kind string, name string, n_refs bigint"),
        spark.createDataFrame(defs, "project_id string, target_file string, name string, n_defs bigint"),
        spark.createDataFrame([("p", "/f3", "s", "/f140.ts", 1)], "project_id string, source_file string, source_symbol string, path string, n bigint"),
        spark.createDataFrame([("p", f"/f{i}") for i in range(150)], "project_id string, file string"))
    want = [tuple(r) for r in index_stats.fan_in(tables.expand(), 4).collect()]
    counted, plain = [], graph.EdgeTables._referrers

    def watched(self, files, imported):
        counted.append(files.count())
        return plain(self, files, imported)

    monkeypatch.setattr(graph.EdgeTables, "_referrers", watched)
    assert [tuple(r) for r in tables.fan_in(4, 2).collect()] == want
    reach = tables.fan_in_bounds()[0].filter(F.col("bound") >= want[-1][2]).count()
    assert sum(counted) < 30 < reach


def _tables(spark, refs, defs, imports, files):
    return graph.EdgeTables(
        spark.createDataFrame(refs, "project_id string, source_file string, source_symbol string, kind string, name string, n_refs bigint"),
        spark.createDataFrame(defs, "project_id string, target_file string, name string, n_defs bigint"),
        spark.createDataFrame(imports, "project_id string, source_file string, source_symbol string, path string, n bigint"),
        spark.createDataFrame([("p", f"/f{i}") for i in range(files)], "project_id string, file string"))


def test_fan_in_knows_how_common_names_overlap(spark, monkeypatch):
    """Most files define names that the same files use: the bounds add up to more than any count, and their files are never paired."""
    monkeypatch.setattr(graph, "BLOCK_FILES", 16)
    refs = [("p", f"/f{i}", "s", "call", f"hot{j}", 1) for i in range(100) for j in range(8)]
    refs += [("p", f"/f{i}", "s", "call", f"own{i % 4}", 1) for i in range(160)]
    defs = [("p", f"/f{i}", f"hot{j}", 1) for i in range(150) for j in range(8)]
    defs += [("p", f"/f{i}", f"{name}{j}", 1) for i in range(150, 156) for name in ("own", "hot") for j in range(4)]
    tables = _tables(spark, refs, defs, [("p", "/f3", "s", "/f140.ts", 1)], 160)
    want = [tuple(r) for r in index_stats.fan_in(tables.expand(), 4).collect()]
    volume, plain = [], graph.EdgeTables._block_referrers

    def watched(self, files, imported, low=0, high=None):
        volume.append(files.count())
        return plain(self, files, imported, low, high)

    monkeypatch.setattr(graph.EdgeTables, "_block_referrers", watched)
    assert [tuple(r) for r in tables.fan_in(4, 10).collect()] == want
    assert volume[0] == 40 and sum(volume[1:]) < 20


@pytest.mark.parametrize("hot", [1, 3, 10])
def test_fan_in_in_waves_of_few_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(graph, "BLOCK_FILES", 16)
    monkeypatch.setattr(graph, "WAVE_ROWS", 700)
    monkeypatch.setattr(graph, "HOT_NAMES", hot)
    rng = random.Random(hot)
    names = [f"n{int(rng.paretovariate(0.8)) % 60}" for _ in range(900)]
    refs = [(f"p{i % 2}" if i % 5 else "p", f"/f{i}", "s", "call", name, 1) for i in range(150) for name in set(rng.sample(names, 5))]
    defs = [(f"p{i % 2}" if i % 3 else "p", f"/f{i}", name, 1) for i in range(150) for name in set(rng.sample(names, 8))]
    imports = [("p", f"/f{i}", "s", f"/f{rng.randrange(9)}.ts", 1) for i in range(0, 150, 4)]
    tables = _tables(spark, refs, defs, imports, 150)
    want = [tuple(r) for r in index_stats.fan_in(tables.expand(), 6).collect()]
    volume, plain = [], graph.EdgeTables._block_referrers

    def watched(self, files, imported, low=0, high=None):
        if high is not None:
            rows = self.definitions.join(files, ["project_id", "target_file"], "left_semi").count()
            volume.append((rows * (high - low), high - low))
        return plain(self, files, imported, low, high)

    monkeypatch.setattr(graph.EdgeTables, "_block_referrers", watched)
    assert [tuple(r) for r in tables.fan_in(6, 2).collect()] == want
    assert volume and all(rows <= 700 or blocks == 1 for rows, blocks in volume)


def test_line_ranges_meet_in_bins(spark, monkeypatch):
    monkeypatch.setattr(search, "BIN_LINES", 8)
    rng = random.Random(5)
    chunks = [("p", f"/f{i % 3}", a, a + rng.choice([0, 0, 3, 40]), i) for i in range(150) for a in [rng.randint(1, 90)]]
    asked = [(i, "p", f"/f{i % 4}", rng.choice([None, 0, 1, 17, 60, 500]), rng.choice([None, 0, 1, 9, 200])) for i in range(60)]
    got = search.chunks_in_range(
        spark.createDataFrame(chunks, "project_id string, file string, line int, line_end int, k int"),
        spark.createDataFrame(asked, "request_id int, project_id string, file string, offset int, limit int"))
    want = []
    for i, _, file, offset, limit in asked:
        low = max(1, offset or 0)
        high = low + limit - 1 if limit else 2**31
        want += [(i, k) for _, f, a, z, k in chunks if f == file and ((not offset and not limit) or (z >= low and a <= high))]
    assert sorted((r.request_id, r.k) for r in got.collect()) == sorted(want)


def test_the_store_loses_nothing(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))

    def corpus(project, files):
        return _corpus(spark, files).withColumn("project_id", F.lit(project))

    def project(name):
        return spark.createDataFrame([(name, f"/{name}")], "project_id string, path string")

    def names():
        return sorted((r.project_id, r.file, r.name) for r in store.chunks().filter("type = 'function'").collect())

    def calls():
        return sorted((r.source_file, r.target_file) for r in store.edges().filter("kind = 'call'").collect())

    one = {"/a/x.ts": "function x(q) {\n  later()\n}\n", "/a/y.ts": "function y(q) {\n  x()\n}\n"}
    indexing.analyze(store, corpus("a", one), project("a"))
    indexing.analyze(store, corpus("b", {"/b/z.ts": "function z(q) {\n}\n"}), project("b"))
    assert names() == [("a", "/a/x.ts", "x"), ("a", "/a/y.ts", "y"), ("b", "/b/z.ts", "z")]
    # a new definition that an unchanged file calls, then the same batch once more
    for _ in range(2):
        done = indexing.update(store, corpus("a", {"/a/new.ts": "function later(q) {\n}\n", "/a/x.ts": one["/a/x.ts"]}), None, "third")
        assert [tuple(r) for r in done.collect()] == [("a", "/a/new.ts", "add")]
        assert calls() == [("/a/x.ts", "/a/new.ts"), ("/a/y.ts", "/a/x.ts")]
    # what was written but not committed is not seen
    store.write("files", store.states().withColumn("status", F.lit("delete")), "open")
    assert len(names()) == 4
    gone = spark.createDataFrame([("a", "/a/x.ts")], "project_id string, file string")
    indexing.update(store, corpus("a", {}), gone)
    assert calls() == [] and len(names()) == 3
    # a full run closes what was before it: new.ts and y.ts are gone since
    indexing.analyze(store, corpus("a", {"/a/x.ts": "function x2(q) {\n}\n"}), project("a"))
    assert names() == [("a", "/a/x.ts", "x2"), ("b", "/b/z.ts", "z")]
    assert store.hashes().count() == 2


def test_index_runs_are_idempotent(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    files = _corpus(spark, {
        "/w/a.ts": "import { b } from './b'\nexport function a(x) {\n  return b(x)\n}\nexport function c(x) {\n}\n",
        "/w/b.ts": "export function b(x) {\n  return x\n}\n", "/w/node_modules/z.ts": "function z(x) {\n}\n",
    })
    projects = spark.createDataFrame([("p", "/w")], "project_id string, path string")
    registry = spark.createDataFrame([("p", "/w", "w", datetime(2024, 1, 1), 0, 0)], schemas.PROJECTS)
    events = spark.createDataFrame([("p", 1, "search", 5, 0, '{"query":"a"}', datetime(2024, 1, 5))], schemas.USAGE_EVENTS)
    ws = Workspace(store, registry, events)
    first = ws.analyze(files, projects, ts="2024-01-02 00:00:00").first()
    again = ws.analyze(files, projects, ts="2024-01-03 00:00:00").first()
    assert (first.chunks, first.files) == (again.chunks, again.files) == (7, 2)
    assert store.meta().filter("key = 'lastIndexed'").first().value == "2024-01-03 00:00:00"
    refs = spark.createDataFrame([("r", "p", "a.ts:a")], "ref_id string, project_id string, ref string")
    assert ws.related(refs, F.lit("/w")).first().text == "/w/b.ts: call->b (out)"
    impact = ws.impact(spark.createDataFrame([("p", "/w/b.ts")], "project_id string, file string")).first().text
    assert impact.startswith("/w/a.ts: call->a, import->")
    q = spark.createDataFrame([("q", "p", "function", None)], "query_id string, project_id string, q string, file_filter string")
    page = ws.search_snippet(q, F.lit("/w")).first()
    assert page.text.startswith('// index search: "function"\n') and "function b @ " in page.text
    read = spark.createDataFrame([("r", "p", "/w/b.ts", 0, 0)], "request_id string, project_id string, file string, offset int, limit int")
    assert "function b @ b.ts:1-3" in ws.read_snippet(read, F.lit("/w")).first().text
    assert ws.dashboard().first().total_files == 2
    report = ws.analytics("month", "2024-01-31 00:00:00")
    assert report["health"].first().zero_chunk_files == 0 and report["timeline"].count() == 30
    assert report["top_queries"].first().query == "a"
    folded = IndexStore(spark, str(tmp_path / "folded"))
    store.compact(folded)
    assert folded.chunks().count() == 7


def test_folding_and_small_files(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    rows = [(f"p{i % 40:02}", f"/f{i}.ts", 30, f"function f{i}(q) {{\n  f{i + 1}()\n}}\n") for i in range(400)]
    files = spark.createDataFrame(rows, schemas.CORPUS).repartition(8)
    names = files.select("project_id", F.concat(F.lit("/"), "project_id").alias("path")).distinct()
    indexing.analyze(store, files, names)
    assert len(store.log("chunks").inputFiles()) <= 48
    for i in range(3):
        indexing.update(store, files.where(f"file = '/f{i}.ts'").withColumn("content", F.lit(f"function g{i}(q) {{\n}}\n")), None)
    before = sorted(map(tuple, store.chunks().collect()))
    assert len(before) == 400 and store.live().select("run").distinct().count() == 4
    store.fold()
    assert sorted(map(tuple, store.chunks().collect())) == before and store.live().select("run").distinct().count() == 1
    assert len(store._of_live("chunks").inputFiles()) <= 48 < len(store.log("chunks").inputFiles())
    with pytest.raises(ValueError):
        store.commit(names, "full", store.live().first().run)


def test_full_runs_and_stream_batches_take_turns(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    disk: dict[str, str] = {}

    def load(keys):
        rows = [("p", f, len(c), c) for f, c in disk.items()]
        return spark.createDataFrame(rows, schemas.CORPUS).join(keys, ["project_id", "file"], "left_semi")

    def names():
        return sorted(r.name for r in store.chunks().filter("type = 'function'").collect())

    project = spark.createDataFrame([("p", "/")], "project_id string, path string")
    handle = changes.index_batches(store, load, "watch")
    batch = lambda *files: spark.createDataFrame([("p", f) for f in files], "project_id string, file string")
    disk |= {"/a.ts": "function a(q) {\n}", "/c.ts": "function old(q) {\n}"}
    handle(batch("/a.ts", "/c.ts"), 0)
    assert names() == ["a", "old"]
    del disk["/a.ts"]
    disk |= {"/b.ts": "function b(q) {\n}", "/c.ts": "function c(q) {\n}", "/d.ts": "function d(q) {\n}"}
    indexing.analyze(store, load(batch(*disk)), project)
    assert names() == ["b", "c", "d"]
    disk["/e.ts"] = "function e(q) {\n}"
    handle(batch("/e.ts"), 1)
    assert names() == ["b", "c", "d", "e"]
    handle(batch("/e.ts"), 1)  # repeated after its commit
    indexing.analyze(store, load(batch(*disk)), project)
    del disk["/b.ts"]
    handle(batch("/b.ts", "/d.ts"), 2)
    assert names() == ["c", "d", "e"]
    with pytest.raises(ValueError):
        changes.index_batches(store, load)(batch("/d.ts"), 0)


def test_discovery_indexes_siblings(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    rows = [("/all/one/package.json", "{}"), ("/all/one/src/a.ts", "function a(x) {\n}"), ("/all/two/go.mod", "m"),
            ("/all/two/m.go", "func M() {\n}"), ("/all/three/readme.md", "# x"), ("/all/self/package.json", "{}")]
    listing = spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, length bigint, content string")
    from corpuscope.plans.indexing import discover

    counts = discover(store, listing, "/all", "/all/self", ts="2024-01-01 00:00:00")
    assert counts.count() == 2
    assert {r.name for r in store.chunks().collect()} == {"a", "M"}


def test_update_matches_full_run(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    before = {"/w/a.ts": "function a(x) {\n  b()\n}\n", "/w/b.ts": "function b(x) {\n}\n", "/w/c.ts": "function c(x) {\n}\n"}
    projects = spark.createDataFrame([("p", "/w")], "project_id string, path string")
    indexing.analyze(store, _corpus(spark, before), projects)
    changed = {"/w/a.ts": "function a(x) {\n  b()\n  d()\n}\n", "/w/b.ts": before["/w/b.ts"], "/w/d.ts": "function d(x) {\n}\n"}
    gone = spark.createDataFrame([("p", "/w/c.ts")], "project_id string, file string")
    status = {r.file: r.status for r in indexing.update(store, _corpus(spark, changed), gone).collect()}
    assert status == {"/w/a.ts": "change", "/w/d.ts": "add", "/w/c.ts": "delete"}
    full_chunks, full_edges, _ = indexing.build_index(_corpus(spark, changed))
    columns = ["file", "name", "type", "line", "line_end", "body"]
    assert sorted(map(tuple, store.chunks().select(*columns).collect())) == sorted(map(tuple, full_chunks.select(*columns).collect()))
    edge = ["source_file", "source_symbol", "target_file", "target_symbol", "kind", "n"]
    assert sorted(map(tuple, store.edges().select(*edge).collect())) == sorted(map(tuple, full_edges.expand().select(*edge).collect()))


def test_event_and_audit_sinks(spark, tmp_path):
    ts = datetime(2024, 1, 1)
    events = spark.createDataFrame([("p", 1, "search", 5, 0, None, ts)], schemas.USAGE_EVENTS)
    append_usage(events, str(tmp_path / "ev"))
    append_usage(events, str(tmp_path / "ev"))
    assert spark.read.parquet(str(tmp_path / "ev")).count() == 2
    audit = spark.createDataFrame([(ts, "s", "Read", "/a.ts", 10, 5), (ts, "s", "Read", "/.env", 10, 5)], schemas.AUDIT)
    append_audit(audit, str(tmp_path / "audit"))
    assert [r.path for r in spark.read.json(str(tmp_path / "audit")).collect()] == ["/a.ts"]


def test_brace_counts(spark):
    df = spark.createDataFrame([("a { '}' } // {\n}\n",)], "t string")
    counts = df.select(symbols.brace_counts("t").alias("c")).first().c
    assert [(c.open, c.close) for c in counts] == [(1, 1), (0, 1), (0, 0)]


def test_a_constant_project_moves_only_texts(spark):
    """Events stay where their file went, in as many tasks as the texts need, and neither side of the join with the texts is broadcast."""
    text = "export function f(a) {\n  return g(a)\n}\n" * 400
    files = spark.range(300).select(F.lit("f").alias("project_id"), F.concat(F.lit("/f"), "id", F.lit(".ts")).alias("file"), F.lit(text).alias("content"))
    parts = symbols.file_partitions(files)
    out = symbols.corpus_chunks(files)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert parts >= 300 * len(text) // symbols.TASK_TEXT and "Broadcast" not in plan
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all(f", {parts}), REPARTITION_BY_NUM" in line for line in dealt)
    assert symbols.file_partitions(files.limit(1)) == 1
    few = symbols.corpus_chunks(files.limit(3))
    assert few.filter("type = 'function'").count() == 3 * 400


def test_text_is_not_read_again_for_every_event(spark):
    """Line counts are worked out before the events of a file are exploded: beside the generator they'd cost a pass over the text each."""
    files = spark.createDataFrame([("p", "/a.ts", "class A {\n}")], "project_id string, file string, content string")
    plan = symbols.block_chunks(files.withColumn("lang", F.lit("typescript")), 2)._jdf.queryExecution().optimizedPlan().toString()
    exploded = [line for line in plan.splitlines() if "Generate explode(" in line and "[e#" in line]
    assert exploded and all("explode(events#" in line for line in exploded)
    assert not any("length(content" in line and "e#" in line for line in plan.splitlines() if line.lstrip("+- :").startswith("Project"))


def test_a_run_reads_its_sources_once(spark, tmp_path):
    """Texts are loaded once for a full run, not again for each of its tables."""
    loaded = spark.sparkContext.accumulator(0)

    def load(k):
        loaded.add(1)
        return f"function f{k}(q) {{\n  f{k + 1}()\n}}\n"

    files = spark.range(40).select(
        F.lit("a").alias("project_id"), F.concat(F.lit("/a/f"), "id", F.lit(".ts")).alias("file"), F.lit(40).cast("bigint").alias("length"),
        F.udf(load)("id").alias("content"))
    store = IndexStore(spark, str(tmp_path / "ix"))
    indexing.index(store, files, spark.createDataFrame([("a", "/a")], "project_id string, path string"))
    assert loaded.value == 40
    assert store.edges().count() == 39


def test_symbols_of_many_texts_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """A project's rows are shared out by file, so neither their writer nor their reader is one task; the rows are the same."""
    files = spark.range(60).select(
        F.lit("a").alias("project_id"), F.concat(F.lit("/a/f"), "id", F.lit(".ts")).alias("file"), F.lit(40).cast("bigint").alias("length"),
        F.concat(F.lit("import { x } from './f1'\nfunction f"), "id", F.lit("(q) {\n  f1()\n}\n")).alias("content"))
    names, found = spark.createDataFrame([("a", "/a")], "project_id string, path string"), []
    for tasks in (1, 4):
        monkeypatch.setattr(indexing, "WRITTEN_TEXT", symbols.text_size(files) // tasks)
        store = IndexStore(spark, str(tmp_path / f"ix{tasks}"))
        indexing.index(store, files, names, "r")
        found.append(sorted(map(tuple, store.chunks().collect())) + sorted(map(tuple, store.edges().collect())))
        for table in ("chunks", "references", "imports"):
            assert len(list((tmp_path / f"ix{tasks}" / table / "run=r" / "project_id=a").glob("*.parquet"))) == tasks
    assert found[0] == found[1]


def test_live_runs_are_found_once_a_commit(spark, tmp_path, monkeypatch):
    """Reads between two commits share the list of live runs; a commit through another object is seen."""
    one, other, asked = IndexStore(spark, str(tmp_path / "ix")), IndexStore(spark, str(tmp_path / "ix")), []
    live = IndexStore.live
    monkeypatch.setattr(IndexStore, "live", lambda self: (asked.append(self), live(self))[1])
    assert one._live_runs() == []
    names = spark.createDataFrame([("a",)], "project_id string")
    other.commit(names, "full", "first")
    asked.clear()
    assert one._live_runs() == one._live_runs() == ["first"] and len(asked) == 1
    other.commit(names, "update", "second")
    assert sorted(one._live_runs()) == ["first", "second"] and len(asked) == 2
