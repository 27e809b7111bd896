"""Keyword search over chunks: trigram-substring matching, BM25, filters and fallback.

Batch form: a table of queries (query_id, project_id, q, n) against the chunk table. Queries are
turned into terms; chunks meet the terms of their own project in a way chosen by the checked
number of terms:

* few terms: one broadcast row per project carries the project's queries, and each chunk row
  finds and scores its own matches. One pass collects term statistics (a bounded table), a
  second one scores; the only rows shuffled are each task's top results.
* many terms: every chunk is exploded to its distinct trigrams, which meet one broadcast anchor
  trigram per term in an equi-join; ``contains`` verifies the pair. Cost per chunk does not grow
  with the number of terms.
* more terms than may be broadcast: the batch of queries is split and each part runs as above.

In the last two cases the matches, not the chunks, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope import dims
from corpuscope.functions import columns as C
from corpuscope.operators.ranking import top_k_per_group
from corpuscope.session import cut_lineage

# More terms than this use the trigram join.
ARRAY_TERM_LIMIT = 2_000
# A batch with more terms than this is split: no larger anchor table is broadcast.
BROADCAST_TERM_LIMIT = 500_000

CHUNK_KEY = ["project_id", "file", "line", "type", "name"]

# How a query text is split.
PART_RE = r"""(?:[^\s"']++|"[^"]*+"|'[^']*+')++"""
FILTER_RE = r"(?is)^(type|file|lang):(.+)$"
PATH_LIKE_RE = r"(?i)\.[a-z0-9]{1,5}$"


def _unquote(text: Column) -> Column:
    quoted = (F.length(text) >= 1) & (
        (text.startswith('"') & text.endswith('"')) | (text.startswith("'") & text.endswith("'"))
    )
    return F.when(quoted, F.substr(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))).otherwise(text)


def _filter_value(parts: Column, key: str) -> Column:
    """Last ``key:value`` of the query."""
    hits = F.filter(parts, lambda p: p.rlike(rf"(?is)^{key}:.+$"))
    value = F.regexp_extract(F.element_at(hits, -1), FILTER_RE, 2)
    return F.when(F.size(hits) > 0, F.lower(_unquote(value)))


def parse_queries(queries: DataFrame, q: str = "q") -> DataFrame:
    """Adds ``terms``, the type/file/lang filters, and ``text``, the string to search for."""
    return (
        queries.withColumn("_parts", F.regexp_extract_all(F.col(q), F.lit(PART_RE), F.lit(0)))
        .withColumn(
            "terms",
            F.transform(
                F.filter(
                    F.transform(F.filter("_parts", lambda p: ~p.rlike(FILTER_RE)), _unquote),
                    lambda t: F.length(t) >= 2,
                ),
                F.lower,
            ),
        )
        .withColumn("type_filter", _filter_value(F.col("_parts"), "type"))
        .withColumn("file_filter", _filter_value(F.col("_parts"), "file"))
        .withColumn("lang_filter", _filter_value(F.col("_parts"), "lang"))
        .withColumn("text", F.when(F.size("terms") > 0, F.array_join("terms", " ")).otherwise(F.col(q)))
        .drop("_parts")
    )


def phrase_query(parsed: DataFrame) -> Column:
    """OR of quoted phrases, with a valid type filter as one more phrase."""
    extra = F.when(F.col("type_filter").isin(*dims.CHUNK_TYPES), F.array("type_filter")).otherwise(
        F.array().cast("array<string>")
    )
    phrases = F.transform(
        F.concat("terms", extra), lambda t: F.concat(F.lit('"'), t, F.lit('"'))
    )
    return F.array_join(phrases, " OR ")


def match_terms(text: C.ColumnLike) -> Column:
    """Index terms of a query text: at most 30 distinct words of two or more characters."""
    words = F.split(F.lower(C.col(text)), "[^a-z0-9_]+", -1)
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2)), 1, dims.MAX_TERMS)


def fallback_terms(text: C.ColumnLike) -> Column:
    words = F.split(F.lower(C.col(text)), "[^a-z0-9]+", -1)
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2)), 1, dims.MAX_TERMS)


def is_path_like(text: C.ColumnLike) -> Column:
    c = C.col(text)
    return c.contains("/") | F.trim(c).rlike(PATH_LIKE_RE)


def result_limit(n: C.ColumnLike) -> Column:
    c = C.col(n)
    return F.least(F.when(c.isNull() | (c <= 0), dims.DEFAULT_RESULTS).otherwise(c), F.lit(dims.MAX_RESULTS))


def plan_queries(queries: DataFrame) -> DataFrame:
    """Parsed queries with match terms, mode and limits.

    Words under three characters have no trigram: in AND mode they make the match empty, in OR
    mode they are ignored.
    """
    df = parse_queries(queries)
    return (
        df.withColumn("_all", match_terms("text"))
        .withColumn("any_mode", is_path_like("text"))
        .withColumn("match", F.filter("_all", lambda t: F.length(t) >= 3))
        .withColumn("dead", ~F.col("any_mode") & (F.size("match") < F.size("_all")))
        .withColumn("fallback", fallback_terms("text"))
        .withColumn("n", result_limit("n"))
        .withColumn("needed", F.when(F.col("any_mode"), F.lit(1)).otherwise(F.size("match")))
        .drop("_all", "terms", "text")
    )


def _query_terms(planned: DataFrame) -> DataFrame:
    return planned.filter(~F.col("dead")).select(
        "query_id", "project_id", "needed", F.explode("match").alias("term")
    )


def _doc_length() -> Column:
    """Number of trigrams in the two indexed columns."""
    return F.greatest(F.length("name") - 2, F.lit(0)) + F.greatest(F.length("content") - 2, F.lit(0))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Rows and mean length per project, the constants of BM25."""
    return chunks.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_docs"), (F.sum(_doc_length()) / F.count(F.lit(1))).alias("avg_len")
    )


def grams(text: Column, n: int) -> Column:
    """All substrings of n word characters, the only ones that terms have. One pass: a substring by its place would count characters from the start."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?=([a-z0-9_]{{{n}}}))"), F.lit(1))


def _self_overlapping(term: Column) -> Column:
    """Whether a term can overlap itself, as ``aa`` does in ``aaa``."""
    return F.when(
        F.length(term) > 1,
        F.exists(F.sequence(F.lit(1), F.length(term) - 1), lambda i: F.left(term, i) == F.right(term, i)),
    ).otherwise(F.lit(False))


def _occurrences(text: Column, term: Column, overlapping: Column) -> Column:
    """Overlapping occurrences; terms are letters, digits and underscores only."""
    removed = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(
        overlapping, F.regexp_count(text, F.concat(F.lit("(?="), term, F.lit(")")))
    ).otherwise((removed / F.length(term)).cast("int"))


def postings(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chunk, term) pairs of a project with occurrence counts, through trigrams.

    ``pairs`` holds distinct (project_id, term), at most BROADCAST_TERM_LIMIT of them.
    """
    text = chunks.withColumn("_name", F.lower("name")).withColumn("_content", F.lower("content"))
    # Rows are told apart by a number of their own, as two chunks may share file, line, type and name. It lives
    # as long as the checkpoint of this result.
    text = text.withColumn("doc_len", _doc_length()).withColumn("_row", F.monotonically_increasing_id())
    anchors = F.broadcast(
        pairs.withColumn("gram", F.substring("term", 1, 3))
        .withColumn("_overlap", _self_overlapping(F.col("term")))
    )
    pieces = F.array_distinct(F.concat(grams(F.col("_name"), 3), grams(F.col("_content"), 3)))
    hits = (
        text.withColumn("gram", F.explode(pieces))
        .join(anchors, ["project_id", "gram"])
        .filter(F.contains("_name", "term") | F.contains("_content", "term"))
    )
    tf = sum(_occurrences(F.col(c), F.col("term"), F.col("_overlap")) for c in ("_name", "_content"))
    return hits.withColumn("tf", tf).drop("_name", "_content", "gram", "_overlap")


def _idf(n_docs: Column, df: Column) -> Column:
    raw = F.ln((n_docs - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(dims.BM25_MIN_IDF))


def _gain(tf: Column, doc_len: Column, avg_len: Column) -> Column:
    k1, b = dims.BM25_K1, dims.BM25_B
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avg_len))


def _passes(query: Column) -> Column:
    """Type, file and language filters of a query against the current chunk."""
    return (
        (query.type_filter.isNull() | (F.col("type") == query.type_filter))
        & (query.file_filter.isNull() | F.contains(F.col("file"), query.file_filter))
        & (query.lang_filter.isNull() | (F.col("lang") == query.lang_filter))
    )


def _inside(columns: tuple[str, ...]):
    def test(word: Column) -> Column:
        out = F.contains(F.col(columns[0]), word)
        for c in columns[1:]:
            out = out | F.contains(F.col(c), word)
        return out

    return test


def _matches(query: Column) -> Column:
    """Whether the current chunk holds the query's terms (all of them, or one in any-mode)."""
    inside = _inside(("_name", "_content"))
    terms = query.terms
    return F.when(query.any_mode, F.exists(terms, lambda t: inside(t.term))).otherwise(
        F.forall(terms, lambda t: inside(t.term))
    )


def _lowered(chunks: DataFrame, body: bool = False) -> DataFrame:
    out = chunks.withColumn("_name", F.lower("name")).withColumn("_content", F.lower("content"))
    return out.withColumn("_body", F.lower("body")) if body else out


def _search_small(
    chunks: DataFrame, planned: DataFrame, ranked: bool, filters: bool, payload: tuple[str, ...]
) -> DataFrame:
    """Search for a batch of at most ARRAY_TERM_LIMIT terms and queries.

    Pass one counts, per project: chunks and their length, chunks per term, chunks per query.
    The counts are at most one row per project, term and query, so they are collected. Pass two
    finds and scores matches inside each chunk row.
    """
    spark = chunks.sparkSession
    live = planned.filter(~F.col("dead") & (F.size("match") > 0))
    term = F.transform(
        "match", lambda t: F.struct(t.alias("term"), _self_overlapping(t).alias("overlap"))
    )
    per_project = live.groupBy("project_id").agg(
        F.collect_list(F.struct("query_id", "any_mode", term.alias("terms"))).alias("_qs"),
        F.array_distinct(F.flatten(F.collect_list("match"))).alias("_terms"),
    )
    asked = planned.select("project_id").distinct().join(per_project, "project_id", "left")
    lean = _lowered(chunks.select("project_id", "name", "content").join(F.broadcast(asked), "project_id"))
    empty = F.array().cast("array<string>")
    keys = F.concat(
        F.array(F.lit("n:")),
        F.coalesce(
            F.transform(
                F.filter("_terms", _inside(("_name", "_content"))), lambda t: F.concat(F.lit("t:"), t)
            ), empty,
        ),
        F.coalesce(
            F.transform(F.filter("_qs", _matches), lambda q: F.concat(F.lit("q:"), q.query_id.cast("string"))), empty
        ),
    )
    counted = (
        lean.select("project_id", F.explode(keys).alias("key"), _doc_length().cast("bigint").alias("len"))
        .groupBy("project_id", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len"))
    )
    counts = counted.toArrow()
    stats = spark.createDataFrame(counts, counted.schema)
    found_ids = {k[2:] for k in counts.column("key").to_pylist() if k.startswith("q:")}
    open_ids = [
        r.query_id for r in planned.filter(F.size("fallback") > 0).select("query_id").collect()
        if str(r.query_id) not in found_ids
    ]
    totals = stats.filter(F.col("key") == "n:").select(
        "project_id", F.col("n").alias("n_docs"), (F.col("len") / F.col("n")).alias("avg_len")
    )
    idf = (
        stats.filter(F.col("key").startswith("t:")).join(totals, "project_id")
        .select("project_id", F.substr("key", F.lit(3)).alias("term"), _idf(F.col("n_docs"), F.col("n")).alias("idf"))
    )
    answered = stats.filter(F.col("key").startswith("q:")).select(
        F.substr("key", F.lit(3)).alias("_answered")
    )
    is_answered = F.col("query_id").cast("string") == F.col("_answered")
    columns = [c for c in payload if c not in CHUNK_KEY]
    out = []
    weighted = (
        live.join(answered, is_answered, "left_semi")
        .select("*", F.explode("match").alias("term"))
        .join(idf, ["project_id", "term"])
        .groupBy("project_id", "query_id", "n", "any_mode", "type_filter", "file_filter", "lang_filter")
        .agg(F.collect_list(F.struct("term", "idf", _self_overlapping(F.col("term")).alias("overlap"))).alias("terms"))
        .join(totals, "project_id")
    )
    if found_ids:
        by_project = weighted.groupBy("project_id", "avg_len").agg(
            F.collect_list(
                F.struct("query_id", "n", "any_mode", "type_filter", "file_filter", "lang_filter", "terms")
            ).alias("_qs")
        )
        base = _lowered(chunks.select(*CHUNK_KEY, *{"content", "lang", *columns}).join(F.broadcast(by_project), "project_id"))
        base = base.withColumn("_len", _doc_length())
        wanted = F.filter("_qs", lambda q: (_passes(q) & _matches(q)) if filters else _matches(q))

        def bm25(q: Column) -> Column:
            def add(acc: Column, t: Column) -> Column:
                tf = sum(_occurrences(F.col(c), t.term, t.overlap) for c in ("_name", "_content"))
                return acc - F.when(tf > 0, t.idf * _gain(tf, F.col("_len"), F.col("avg_len"))).otherwise(0.0)

            return F.aggregate(q.terms, F.lit(0.0), add)

        value = bm25 if ranked else (lambda q: F.lit(0.0))
        scored = F.transform(
            wanted, lambda q: F.struct(q.query_id.alias("query_id"), q.n.alias("n"), value(q).alias("score"))
        )
        out.append(base.withColumn("_hit", F.explode(scored)))
    unanswered = planned.filter(F.size("fallback") > 0).join(answered, is_answered, "left_anti")
    if open_ids:
        by_project = unanswered.groupBy("project_id").agg(
            F.collect_list(
                F.struct("query_id", "n", "type_filter", "file_filter", "lang_filter", F.col("fallback").alias("words"))
            ).alias("_qs")
        )
        base = _lowered(
            chunks.select(*CHUNK_KEY, *{"content", "body", "lang", *columns}).join(F.broadcast(by_project), "project_id"),
            body=True,
        )
        found = _inside(("_name", "_content", "_body"))
        wanted = F.filter(
            "_qs",
            lambda q: (_passes(q) & F.exists(q.words, found)) if filters else F.exists(q.words, found),
        )
        scored = F.transform(
            wanted, lambda q: F.struct(q.query_id.alias("query_id"), q.n.alias("n"), F.lit(0.0).alias("score"))
        )
        out.append(base.withColumn("_hit", F.explode(scored)))
    shape = ["_hit.query_id", *CHUNK_KEY, "_hit.score", *columns, "_hit.n"]
    if not out:
        none = chunks.select(*CHUNK_KEY, *columns).limit(0)
        key_type = planned.schema["query_id"].dataType
        rows = none.select(
            F.lit(None).cast(key_type).alias("query_id"), *CHUNK_KEY, F.lit(0.0).alias("score"), *columns,
            F.lit(0).alias("n"),
        )
    else:
        rows = out[0].select(*shape)
        for more in out[1:]:
            rows = rows.unionByName(more.select(*shape))
    return _top(rows).drop("n")


def _top(rows: DataFrame) -> DataFrame:
    # Sums of doubles depend on their order in the last bits; ranking must not.
    order = [F.round("score", 12).asc(), F.asc("file"), F.asc("line"), F.asc("type"), F.asc("name")]
    top = top_k_per_group(rows, ["query_id"], order, dims.MAX_RESULTS)
    return top.filter(F.col("rank") <= F.col("n"))


def _score_postings(hits: DataFrame, chunks: DataFrame, terms: DataFrame, payload: list[str]) -> DataFrame:
    """BM25 per (query, chunk); lower is better. Rows lacking a needed term are dropped."""
    n_docs = F.broadcast(corpus_stats(chunks))  # one row per project with a query
    doc_freq = hits.groupBy("project_id", "term").agg(F.count(F.lit(1)).alias("doc_freq"))
    weights = (
        terms.join(doc_freq, ["project_id", "term"])
        .join(n_docs, "project_id")
        .withColumn("idf", _idf(F.col("n_docs"), F.col("doc_freq")))
        .select("query_id", F.col("project_id").alias("_project"), F.col("term").alias("_term"), "needed", "idf", "avg_len")
    )
    # At most a row per term of the batch. The columns of a row depend on its number; as keys they need no sort.
    return (
        hits.join(F.broadcast(weights), (F.col("project_id") == F.col("_project")) & (F.col("term") == F.col("_term")))
        .groupBy("query_id", "needed", "_row", *CHUNK_KEY, *[c for c in payload if c not in CHUNK_KEY])
        .agg(
            F.sum(-F.col("idf") * _gain(F.col("tf"), F.col("doc_len"), F.col("avg_len"))).alias("score"),
            F.count(F.lit(1)).alias("_found"),
        )
        .filter(F.col("_found") >= F.col("needed"))
        .drop("_found", "needed", "_row")
    )


def _admitted(rows: DataFrame, planned: DataFrame, filters: bool) -> DataFrame:
    """Rows with the limit of their query, without those that its filters reject."""
    rows = rows.join(F.broadcast(planned.select("query_id", "n", "type_filter", "file_filter", "lang_filter")), "query_id")
    if filters:
        rows = rows.filter(
            (F.col("type_filter").isNull() | (F.col("type") == F.col("type_filter")))
            & (F.col("file_filter").isNull() | F.contains("file", "file_filter"))
            & (F.col("lang_filter").isNull() | (F.col("lang") == F.col("lang_filter")))
        )
    return rows.drop("type_filter", "file_filter", "lang_filter")


def _fallback(
    chunks: DataFrame, planned: DataFrame, answered: DataFrame, payload: list[str], filters: bool
) -> DataFrame:
    """Queries without a ranked match: the first n rows that hold any word anywhere in name, content or body, score 0.

    They are among the first n of each word, which each task cuts before rows move.

    With no such query the join side is empty and adaptive execution skips the scan.
    """
    open_queries = planned.filter(F.size("fallback") > 0).join(answered, "query_id", "left_anti")
    texts = _lowered(chunks, body=True).withColumn("_row", F.monotonically_increasing_id())
    inside = _inside(("_name", "_content", "_body"))
    extra = [c for c in payload if c not in CHUNK_KEY]
    anchors = open_queries.select("query_id", "project_id", F.explode("fallback").alias("word"))
    anchors = F.broadcast(anchors.withColumn("gram", F.substring("word", 1, 2)))
    pieces = F.array_distinct(F.concat(*[grams(F.col(c), 2) for c in ("_name", "_content", "_body")]))
    hits = (
        texts.withColumn("gram", F.explode(pieces))
        .join(anchors, ["project_id", "gram"])
        .filter(inside(F.col("word")))
        .select("query_id", "word", "_row", *CHUNK_KEY, *{"lang", *extra})
    )
    order = [F.asc(c) for c in ("file", "line", "type", "name")]
    first = top_k_per_group(_admitted(hits, planned, filters), ["query_id", "word"], order, dims.MAX_RESULTS).filter("rank <= n")
    return first.dropDuplicates(["query_id", "_row"]).select("query_id", *CHUNK_KEY, F.lit(0.0).alias("score"), *extra, "n")


def batch_terms(planned: DataFrame) -> int:
    """Upper bound of the number of terms in a batch: the size of what may be broadcast."""
    n = planned.agg(F.sum(F.size("match") + F.size("fallback") + 1)).first()[0]
    return int(n or 0)


def search(
    chunks: DataFrame,
    queries: DataFrame,
    ranked: bool = True,
    filters: bool = True,
    payload: tuple[str, ...] = ("line_end", "lang"),
    by_gram: bool | None = None,
    within: str | None = None,
) -> DataFrame:
    """Top n chunks per query, best first, with ``score`` and ``rank``.

    Every chunk row counts, also where several share file, line, type and name. The number of terms decides how a batch
    is run, not what it gives. ``within`` names a column of the queries: part of a path that a result's file must hold
    (null: any); it takes the place of the filters in the query text.

    Type, file and language filters apply before the cut, so a query gets its n results even
    when its best matches are filtered out. Statistics cover the whole project. ``ranked=False``
    skips scoring (order by place).
    """
    if within is None:
        planned = plan_queries(queries)
    else:
        planned = plan_queries(queries.withColumnRenamed(within, "_within")).withColumns({
            "file_filter": F.col("_within"), "type_filter": F.lit(None).cast("string"), "lang_filter": F.lit(None).cast("string"),
        }).drop("_within")
        filters = True
    head = planned.limit(ARRAY_TERM_LIMIT + 1).toArrow()  # bounded; decides how to run
    if head.num_rows <= ARRAY_TERM_LIMIT:
        planned = chunks.sparkSession.createDataFrame(head, planned.schema)
        size = sum(len(r["match"] or []) + len(r["fallback"] or []) + 1 for r in head.select(["match", "fallback"]).to_pylist())
    else:
        size = batch_terms(planned)
    if size > BROADCAST_TERM_LIMIT:
        # Hash buckets well under the limit; every part scans the chunks once.
        parts = 2 * (size // BROADCAST_TERM_LIMIT + 1)
        bucket = F.pmod(F.xxhash64("query_id"), F.lit(parts))
        out = None
        for i in range(parts):
            part = _search_large(chunks, planned.filter(bucket == i), ranked, filters, payload)
            out = part if out is None else out.unionByName(part)
        return out
    use_grams = size > ARRAY_TERM_LIMIT if by_gram is None else by_gram
    run = _search_large if use_grams else _search_small
    top = run(chunks, planned, ranked, filters, tuple(c for c in payload if c != "body"))
    if "body" in payload:
        # Bodies are fetched for results only: at most MAX_RESULTS rows per query.
        keys = top.select(*CHUNK_KEY).distinct()
        bodies = chunks.select(*CHUNK_KEY, "body").join(keys, CHUNK_KEY, "left_semi")
        top = top.join(bodies.groupBy(*CHUNK_KEY).agg(F.min("body").alias("body")), CHUNK_KEY)
    return top


def _search_large(
    chunks: DataFrame, planned: DataFrame, ranked: bool, filters: bool, payload: tuple[str, ...]
) -> DataFrame:
    planned = cut_lineage(planned)
    columns = [c for c in payload if c not in CHUNK_KEY]
    chunks = chunks.join(F.broadcast(planned.select("project_id").distinct()), "project_id", "left_semi")
    lean = chunks.select(*CHUNK_KEY, *{"content", *columns})
    terms = _query_terms(planned)
    # Read twice, for document frequencies and for scores; far smaller than the chunks.
    hits = cut_lineage(postings(lean, terms.select("project_id", "term").distinct()).drop(*{"content"}.difference(columns)))
    found = cut_lineage(_score_postings(hits, lean, terms, columns))
    rest = _fallback(chunks, planned, found.select("query_id").distinct(), columns, filters)
    rows = _admitted(found, planned, filters)
    rows = rows.select("query_id", *CHUNK_KEY, "score", *columns, "n").unionByName(rest)
    if not ranked:
        rows = rows.withColumn("score", F.lit(0.0))
    return _top(rows).drop("n")


# ---------------------------------------------------------------- lookups


def chunks_of_file(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of files(project_id, file); readers order them by line, name and type."""
    return chunks.join(files.select("project_id", "file").distinct(), ["project_id", "file"], "left_semi")


#: Lines of a bin in which requests and chunks meet.
BIN_LINES = 64


def chunks_in_range(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Chunks that overlap the requested lines: requests(request_id, project_id, file, offset, limit).

    Lines are cut into bins, and a request meets a chunk by file and bin, so the requests of one file spread over its bins. A pair is
    taken in the first bin that both have, hence once. Open requests end with the last line of the file's chunks.
    """
    span = chunks.groupBy("project_id", "file").agg(F.min("line").alias("_low"), F.max(F.greatest("line", "line_end")).alias("_high"))
    start = F.greatest(F.lit(1), F.coalesce("offset", F.lit(0)))
    whole = (F.coalesce("offset", F.lit(0)) == 0) & (F.coalesce("limit", F.lit(0)) == 0)
    end = F.when(F.coalesce("limit", F.lit(0)) > 0, F.least(start.cast("bigint") + F.col("limit") - 1, F.col("_high"))).otherwise(F.col("_high"))
    req = requests.join(span, ["project_id", "file"]).select(
        "request_id", "project_id", "file", F.when(whole, F.col("_low")).otherwise(F.greatest(start, F.col("_low"))).cast("bigint").alias("_from"),
        end.cast("bigint").alias("_to")).filter("_from <= _to")

    def bins(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / BIN_LINES), F.floor(high / BIN_LINES))

    low, high = F.col("line").cast("bigint"), F.greatest("line", "line_end").cast("bigint")
    spread = chunks.withColumn("_bin", F.explode(bins(low, high)))
    asked = req.withColumn("_bin", F.explode(bins(F.col("_from"), F.col("_to"))))
    return (
        spread.join(asked, ["project_id", "file", "_bin"])
        .filter((F.col("line_end") >= F.col("_from")) & (F.col("line") <= F.col("_to")))
        .filter(F.col("_bin") == F.floor(F.greatest(low, F.col("_from")) / BIN_LINES))
        .drop("_from", "_to", "_bin")
    )


def files_matching(chunks: DataFrame, pattern: str) -> DataFrame:
    """Distinct files whose path matches a glob, ignoring case."""
    like = pattern.lower()
    for old, new in (("\\", "\\\\"), ("%", "\\%"), ("_", "\\_"), ("**", "%"), ("*", "%"), ("?", "_")):
        like = like.replace(old, new)
    return chunks.select("file").distinct().filter(F.lower("file").like(like))
