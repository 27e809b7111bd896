"""Stored postings against the plain search, with blocks that are skipped and rows that are dead."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from corpuscope import schemas
from corpuscope.operators import postings, search
from corpuscope.plans import indexing
from corpuscope.session import cut_lineage
from corpuscope.sources.sinks import IndexStore

WORDS = ["thing", "nothing", "things", "the", "other", "aaa", "aaaa", "x_1", "un", "zed", "Über", "été", "snake_case_name", "İx"]
QUERIES = [
    ("a", "p", "thing", 5), ("b", "p", "the thing", 3), ("c", "q", "aaa", 4), ("d", "q", "src/the zed", 6), ("e", "p", "un the", 4),
    ("f", "p", "nowhere at all", 4), ("g", "q", "type:function thing", 3), ("h", "p", "file:f1 the", 200), ("i", "q", "", 3), ("j", "z", "thing", 3),
    ("k", "p", "case_na", 2), ("l", "p", "hing", 1), ("m", "q", "e_1 x_1", 5), ("n", "p", "body", 3), ("o", "q", "lang:go other", 2), ("p", "p", "x", 3),
]


def random_chunks(spark, n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))
        name = rng.choice(WORDS)
        rows.append((rng.choice("pq"), str(i), f"f{i % 17}", name, rng.choice(["function", "class"]), i % 5, i % 5, text, text + " body" * (i % 3), rng.choice(["go", "js"])))
    return spark.createDataFrame(rows + rows[:9], schemas.CHUNKS)


def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id string, project_id string, q string, n int")


def found(df):
    return sorted(tuple(r) for r in df.withColumn("score", F.round("score", 9)).collect())


@pytest.mark.parametrize("ranked", [True, False])
def test_equals_plain_search(spark, tmp_path, monkeypatch, ranked):
    monkeypatch.setattr(postings, "BLOCK_BITS", 3)
    monkeypatch.setattr(postings, "WAVE", 1)
    chunks = random_chunks(spark, 400)
    index = postings.PostingIndex(spark, str(tmp_path))
    index.add(chunks, "one")
    options = dict(ranked=ranked, filters=ranked, payload=("line_end", "lang", "body") if ranked else ("lang",))
    plain = search.search(chunks, asked(spark), **{**options, "payload": ("line_end", "lang") if ranked else ("lang",)})
    got = index.search(asked(spark), **options)
    if ranked:
        assert all(r.body is not None for r in got.collect())
    assert found(got.drop("body")) == found(plain)


def test_blocks_under_the_nth_score_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_BITS", 3)
    monkeypatch.setattr(postings, "WAVE", 1)
    rows = [("p", str(i), f"f{i}", "name", "function", 1, 1, "needle " * (1 + (i < 4)) + "word " * (i // 8), "", "go") for i in range(400)]
    chunks = spark.createDataFrame(rows, schemas.CHUNKS)
    index = postings.PostingIndex(spark, str(tmp_path))
    index.add(chunks, "one")
    queries = spark.createDataFrame([("a", "p", "needle", 4), ("b", "p", "needle word", 3)], "query_id string, project_id string, q string, n int")
    planned = cut_lineage(search.plan_queries(queries))
    held = index.term_rows(index._words_of(search._query_terms(planned)))
    weights, blocks = index.plan_blocks(search._query_terms(planned), held)
    first = index._described(index._scored(blocks.where("place <= 1"), weights, held), planned, True, [])
    scored = {r.query_id: r.n for r in index.reaching(blocks, first).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    total = {r.query_id: r.n for r in blocks.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    skipped = {q: total[q] - 1 - scored.get(q, 0) for q in total}
    assert min(total.values()) >= 49 and skipped["a"] >= 40 and skipped["b"] >= 40, (total, skipped)
    assert found(index.search(queries)) == found(search.search(chunks, queries))


def test_scans_read_asked_grams_only(spark, tmp_path):
    index = postings.PostingIndex(spark, str(tmp_path))
    index.add(random_chunks(spark, 50), "one")
    terms = spark.createDataFrame([("thing",)], "term string")
    assert {r.word for r in index.matched(terms).collect()} == {"thing", "nothing", "things"}
    table = index._asked("words", "gram", spark.createDataFrame([("thi",), ("hin",)], "gram string"))
    assert {r.gram for r in table.select("gram").distinct().collect()} == {"thi", "hin"}
    assert "PartitionFilters: [isnotnull(part" in table._jdf.queryExecution().toString() or "part#" in table._jdf.queryExecution().executedPlan().toString()


def test_a_searchable_store_follows_its_runs(spark, tmp_path):
    def corpus(files):
        return spark.createDataFrame([("p", f, len(c), c) for f, c in files.items()], schemas.CORPUS)

    store = IndexStore(spark, str(tmp_path / "a"), searchable=True)
    names = spark.createDataFrame([("p", "/")], "project_id string, path string")
    queries = spark.createDataFrame(
        [("1", "p", "needle", 9), ("2", "p", "function", 9), ("3", "p", "gone thing", 9)], "query_id string, project_id string, q string, n int")
    files = {f"/f{i}.ts": f"function needle{i}(q) {{\n  thing()\n}}\n" for i in range(12)}
    indexing.analyze(store, corpus(files), names)
    indexing.update(store, corpus({"/f1.ts": "function other(q) {\n  gone()\n}\n", "/f2.ts": "function needle(needle) {\n}\n"}), None)
    indexing.update(store, corpus({}), spark.createDataFrame([("p", "/f3.ts")], "project_id string, file string"))
    want = found(search.search(store.chunks(), queries))
    assert len(want) == 27 and found(store.search(queries)) == want
    store.fold()
    assert found(store.search(queries)) == want


def test_words_are_gathered_where_their_block_is(spark, tmp_path):
    """Texts move once, by block; a row is held once per word, with its occurrences in name and content."""
    index = postings.PostingIndex(spark, str(tmp_path))
    index.add(spark.createDataFrame([
        ("p", "0", "f", "Needle", "function", 1, 1, "needle ab needle", "needle ab needle", "go"),
        ("p", "1", "f", "x", "function", 2, 2, "cut", "cut needle needle ab", "go")], schemas.CHUNKS), "one")
    rows = index.read("rows")
    plan = postings.row_postings(rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(block" in plan
    held = {(r.word, e.tf) for r in index.read("postings").collect() for e in r.entries}
    assert held == {("needle", 3), ("needle", 0), ("ab", 0), ("cut", 1)}
    assert {r.word: r.rows for r in index.read("words").filter("length(gram) = 2").collect()} == {"needle": 2, "ab": 2, "cut": 1}
    texts = index.read("rows").select("content", F.repeat("body", 1 << 20).alias("body"))
    assert postings.text_tasks(texts, postings.TASK_TEXT) >= (36 << 20) // postings.TASK_TEXT


def test_first_rows_settle_queries_of_frequent_words(spark, tmp_path, monkeypatch):
    """Postings are read only for words of queries that the first rows of a project leave open; results are those of the plain search."""
    monkeypatch.setattr(postings, "FRONT", (4, 20))
    texts = [f"of{' is' * (i % 9 == 8)} x{' needle' * (i in (3, 333))}" for i in range(400)]
    rows = [("p", str(i), f"f{i:03}", "name", "function", 1, 1, t, t, "go") for i, t in enumerate(texts)]
    rows += [("q", "0", "f", "name", "function", 1, 1, "un", "un", "go")]
    chunks = spark.createDataFrame(rows, schemas.CHUNKS)
    index = postings.PostingIndex(spark, str(tmp_path))
    index.add(chunks, "one")
    queries = spark.createDataFrame(
        [("a", "p", "of zz", 4), ("b", "p", "is zz", 2), ("c", "p", "zz needle", 3), ("d", "q", "un zz", 5), ("e", "p", "type:class of zz", 2)],
        "query_id string, project_id string, q string, n int")
    read, plain = [], postings.PostingIndex._words_of
    monkeypatch.setattr(postings.PostingIndex, "_words_of", lambda self, terms: read.append({r.term for r in terms.collect()}) or plain(self, terms))
    got = found(index.search(queries))
    assert got == found(search.search(chunks, queries)) and {r[0] for r in got} == {"a", "b", "c", "d"}
    assert read[-1] == {"zz", "needle", "of"}  # of: the query with a filter
    assert len(read) == 2


def test_a_body_that_equals_its_content_is_stored_once(spark, tmp_path):
    rows = [("p", "0", "f", "a", "function", 1, 1, "same", "same", "go"), ("p", "1", "f", "b", "function", 2, 2, "cut", "cut off", "go"),
            ("p", "2", "f", "c", "function", 3, 3, "none", None, "go"), ("p", "3", "f", "d", "function", 4, 4, None, None, "go")]
    index = postings.PostingIndex(spark, str(tmp_path))
    index.add(spark.createDataFrame(rows, schemas.CHUNKS), "one")
    stored = spark.read.parquet(f"{tmp_path}/rows/segment=one")
    assert sorted((r.name, r.body) for r in stored.collect()) == [("a", None), ("b", "cut off"), ("c", None), ("d", None)]
    assert sorted((r.name, r.body) for r in index.read("rows").collect()) == [("a", "same"), ("b", "cut off"), ("c", None), ("d", None)]


def test_entries_are_shuffled_as_numbers(spark):
    entries = [(0, 1, 2), (511, 1 << 30, (1 << 31) - 1)]
    df = spark.createDataFrame([(entries,), ([(7, 0, 5)],)], "entries array<struct<slot:int,tf:int,len:int>>")
    packed = df.withColumn("entries", postings._packed("entries"))
    assert packed.first().entries == [x for e in entries for x in e]
    back = packed.withColumn("entries", postings._unpacked("entries"))
    assert back.schema["entries"].dataType.simpleString() == df.schema["entries"].dataType.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_shuffles_of_ended_steps_are_freed(spark):
    """Files of a shuffle go with the action that wrote it, not when the driver collects its garbage."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for f in map(str, (files.getAllFiles().apply(i) for i in range(files.getAllFiles().size()))) if "/shuffle_" in f}
    before = held()
    left = [cut_lineage(spark.range(10_000).repartition(5, "id").groupBy("id").count()) for _ in range(2)]
    assert sum(df.count() for df in left) == 20_000
    for _ in range(100):
        if not held() - before:
            return
        time.sleep(0.1)
    raise AssertionError(held() - before)
