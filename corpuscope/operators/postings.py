"""Stored postings: keyword search that reads only the grams, words and blocks a batch of queries asks for.

A search term consists of letters a-z, digits and underscores, so every occurrence of it lies within one word of the lowered text.
The index therefore keeps

* ``rows``: the chunks, numbered by (project, length), a body that equals the content kept once; 512 neighbours are a block,
* ``postings``: per project, word and block the rows that hold the word anywhere, with lengths and the counts in name and content,
* ``words``: the two- and three-letter grams of each distinct word, with the number of rows that hold it,
* ``stats``: chunks and total length per project.

A term looks up its rarest gram, ``contains`` decides which of its words hold the term, and their postings give its rows and exact
counts, once for all queries of a batch. Blocks are ranked per query by the sum of each term's best gain in them, which no row
exceeds; the first ``WAVE`` are scored, and of the rest only those that could still reach the n-th score so far. The result is that
of ``search.search``.

Each ``add`` writes a segment of its own, so an index run never rewrites what others wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope import schemas
from corpuscope.operators import search as S
from corpuscope.operators.ranking import MAP_SIDE_LIMIT, top_k_per_group
from corpuscope.session import cut_lineage

#: Rows of a block: row numbers differ in the last bits only.
BLOCK_BITS = 9
#: Folders that words and postings are dealt to, by a hash of the gram or word.
PARTS = 16
#: Blocks per query that are scored before the others are compared with the n-th score.
WAVE = 4
#: A list of at most so many grams or words is handed to the scan as a filter.
LIST_LIMIT = 2_000
#: Rows of a project, first ones by place, that are looked at for queries without a ranked match before any postings are; in parts so many.
FRONT, SLICES = (100, MAP_SIDE_LIMIT), 16
#: At most so many row numbers are handed to all tasks of a scan.
ROW_LIMIT = 200_000
#: Scores are compared after rounding; a bound so close to the n-th score still counts.
NEAR = 1e-9

WORD_RE = "[a-z0-9_]+"
PLACE = ("file", "line", "type", "name")
#: Bytes of content and body of a task that numbers rows or gathers words, and of one that writes postings; fewer than the last aren't worth one.
TASK_TEXT, WRITE_TEXT, LEAST_TEXT = 8 << 20, 32 << 20, 64 << 10
_CHUNK = [c.strip().split(" ")[0] for c in schemas.CHUNKS.split(",")]
TABLES = {
    "rows": schemas.CHUNKS + ", row BIGINT, len INT, whole BOOLEAN",
    "postings": "project_id STRING, word STRING, block BIGINT, entries ARRAY<STRUCT<slot: INT, tf: INT, len: INT>>, part INT",
    "words": "gram STRING, word STRING, rows BIGINT, part INT",
    "stats": "project_id STRING, n_docs BIGINT, total_len BIGINT",
}


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD_RE), F.lit(0))


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def text_tasks(chunks: DataFrame, task_bytes: int) -> int:
    """Tasks that chunks are dealt to by the size of their texts, so that a task's words don't grow with the corpus."""
    size = sum(F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in ("content", "body"))
    total = int(chunks.agg(F.sum(size)).first()[0] or 0)
    return max(1, min(chunks.sparkSession.sparkContext.defaultParallelism, total // LEAST_TEXT), total // task_bytes)


def row_postings(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """(project_id, word, block, entries) of numbered rows: each row that holds the word anywhere, with its occurrences in name and content
    (0: in the body only, or too short a word to rank). Entries of a block are at most its rows.

    Texts are dealt by block once; words are counted and gathered where their block is."""
    slot = F.col("row").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
    other = F.when(~F.col("content").eqNullSafe(F.col("body")), F.col("body"))  # has no word that the content hasn't, if null
    base = rows.select("project_id", F.shiftright("row", BLOCK_BITS).alias("block"), slot.alias("slot"), "len", "name", "content", other.alias("body"))
    base = base.repartition(tasks, "block") if tasks else base.repartition("block")
    held = F.filter(F.concat(_words("name"), _words("content")), lambda w: F.length(w) >= 2)
    more = F.array_distinct(F.filter(_words("body"), lambda w: F.length(w) >= 2))
    each = F.concat(
        F.transform(held, lambda w: F.struct(w.alias("word"), F.when(F.length(w) >= 3, 1).otherwise(0).alias("n"))),
        F.transform(more, lambda w: F.struct(w.alias("word"), F.lit(0).alias("n"))))
    found = base.select("project_id", "block", "slot", "len", F.inline(each)).groupBy("project_id", "block", "word", "slot", "len").agg(
        F.sum("n").cast("int").alias("tf"))
    return found.groupBy("project_id", "word", "block").agg(F.sort_array(F.collect_list(F.struct("slot", "tf", "len"))).alias("entries"))


def _packed(entries: str) -> Column:
    """Entries as numbers in a row, so that few bytes are shuffled."""
    return F.flatten(F.transform(entries, lambda e: F.array(e["slot"], e["tf"], e["len"])))


def _unpacked(packed: str) -> Column:
    at = lambda i, k: F.get(F.col(packed), 3 * i + k)
    return F.transform(F.sequence(F.lit(0), (F.size(packed) / 3 - 1).cast("int")),
                       lambda i: F.struct(at(i, 0).alias("slot"), at(i, 1).alias("tf"), at(i, 2).alias("len")))


def indexed(entries: Column | str) -> Column:
    """Entries of the rows that hold the word in name or content."""
    return F.filter(entries, lambda e: e["tf"] > 0)


def word_grams(postings: DataFrame) -> DataFrame:
    """(gram, word, rows): the two- and three-letter grams of all words; rows that hold the word anywhere."""
    words = postings.groupBy("word").agg(F.sum(F.size("entries")).alias("rows"))
    grams = F.array_distinct(F.concat(S.grams(F.col("word"), 3), S.grams(F.col("word"), 2)))
    return words.select(F.explode(grams).alias("gram"), "word", "rows")


class PostingIndex:
    """Segments of postings under one folder."""

    def __init__(self, spark: SparkSession, root: str, segments: list[str] | None = None):
        """``segments``: those to read; all if not given."""
        self.spark, self.root, self.segments = spark, root, segments

    def add(self, chunks: DataFrame, segment: str) -> None:
        """Index the chunks as one segment; a repeated call replaces it. Rows of one project and like length become neighbours."""
        path = lambda name: f"{self.root}/{name}/segment={segment}"
        order = ["project_id", "len", "file", "line"]
        tasks, writers = (text_tasks(chunks, size) for size in (TASK_TEXT, WRITE_TEXT))
        write = lambda df, *parts: df.write.mode("overwrite").option("compression", "zstd").partitionBy(*parts).parquet
        whole = F.col("content").eqNullSafe(F.col("body"))
        numbered = (
            chunks.select(*_CHUNK, whole.alias("whole")).withColumn("body", F.when(~F.col("whole"), F.col("body")))
            .withColumn("len", S._doc_length().cast("int")).repartitionByRange(tasks, *order)
            .sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
        )
        write(numbered)(path("rows"))
        rows = self.read("rows", segment)
        dealt = row_postings(rows, tasks).withColumn("entries", _packed("entries")).repartition(writers, "word")
        write(dealt.withColumn("part", _part("word")).sortWithinPartitions("part", "word").withColumn("entries", _unpacked("entries")), "part")(path("postings"))
        dealt = word_grams(self.read("postings", segment)).repartition(writers, "gram")
        write(dealt.withColumn("part", _part("gram")).sortWithinPartitions("part", "gram", "word"), "part")(path("words"))
        write(rows.groupBy("project_id").agg(F.count("*").alias("n_docs"), F.sum("len").alias("total_len")))(path("stats"))

    def read(self, name: str, segment: str | None = None) -> DataFrame:
        """A table with the column ``segment``, of all segments or one."""
        base = f"{self.root}/{name}"
        chosen = self.segments if segment is None else [segment]
        paths = [base] if chosen is None else [f"{base}/segment={s}" for s in chosen]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name] + ", segment STRING")
        found = self.spark.read.schema(TABLES[name] + ", segment STRING").option("basePath", base).parquet(*paths)
        # A body that equals the content is kept once.
        return found.withColumn("body", F.when(F.col("whole"), F.col("content")).otherwise(F.col("body"))) if name == "rows" else found

    def _asked(self, name: str, key: str, asked: DataFrame) -> DataFrame:
        """The table without what no row of ``asked`` (with the column ``key``) names, as far as a list of bounded size can say so."""
        table = self.read(name)
        keys = [r[0] for r in asked.select(key).distinct().limit(LIST_LIMIT + 1).collect()]
        if len(keys) > LIST_LIMIT:
            return table
        parts = [r[0] for r in self.spark.createDataFrame([(k,) for k in keys], f"{key} string").select(_part(key)).distinct().collect()]
        return table.where(F.col("part").isin(parts) & F.col(key).isin(keys))

    def matched(self, terms: DataFrame) -> DataFrame:
        """(term, word, occurrences) of the words that hold a term; ``terms``: distinct (term). A term reads the words of its rarest gram;
        one that has a gram no word has matches nothing."""
        size = F.least(F.length("term"), F.lit(3))
        each = F.transform(F.sequence(F.lit(1), F.length("term") - size + 1), lambda i: F.substr(F.col("term"), i, size))
        asked = terms.where(F.length("term") >= 2).select("term", F.explode(F.array_distinct(each)).alias("gram"))
        words = self._asked("words", "gram", asked).select("gram", "word").distinct()
        counts = words.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").count()
        known = asked.join(counts, "gram", "left").withColumn("count", F.coalesce("count", F.lit(0)))
        rarest = known.groupBy("term").agg(F.min(F.struct("count", "gram")).alias("g")).where("g.count > 0")
        return (
            rarest.select("term", F.col("g.gram").alias("gram")).join(words, "gram").where(F.contains("word", "term"))
            .select("term", "word", S._occurrences(F.col("word"), F.col("term"), S._self_overlapping(F.col("term"))).alias("occurrences"))
        )

    def _words_of(self, terms: DataFrame) -> DataFrame:
        """(project_id, term, word, occurrences) for terms(project_id, term) of queries."""
        return cut_lineage(terms.select("project_id", "term").distinct().join(self.matched(terms.select("term").distinct()), "term"))

    def _dead(self, live: DataFrame | None) -> DataFrame | None:
        """(segment, block, dead): slots of rows whose file isn't live in their segment."""
        if live is None:
            return None
        gone = self.read("rows").select("segment", "project_id", "file", "row", "len").join(live, ["segment", "project_id", "file"], "left_anti")
        return cut_lineage(gone.select("segment", "project_id", "len", F.shiftright("row", BLOCK_BITS).alias("block"),
                                       F.col("row").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("slot")))

    def _postings(self, asked: DataFrame, ranked: bool, dead: DataFrame | None) -> DataFrame:
        """Postings of asked(project_id, term, word, occurrences), without dead rows. ``ranked``: of words in name and content only."""
        out = self._asked("postings", "word", asked)
        if ranked:
            out = out.withColumn("entries", indexed("entries")).where(F.size("entries") > 0)
        out = out.join(asked, ["project_id", "word"])
        if dead is None:
            return out
        slots = dead.groupBy("segment", "block").agg(F.collect_set("slot").alias("dead"))
        alive = F.filter("entries", lambda e: ~F.coalesce(F.array_contains("dead", e["slot"]), F.lit(False)))
        return out.join(slots, ["segment", "block"], "left").withColumn("entries", alive).where(F.size("entries") > 0).drop("dead")

    def _stats(self, dead: DataFrame | None) -> DataFrame:
        totals = self.read("stats").select("project_id", "n_docs", "total_len")
        if dead is not None:
            totals = totals.unionByName(dead.groupBy("project_id").agg((-F.count("*")).alias("n_docs"), (-F.sum("len")).alias("total_len")))
        totals = totals.groupBy("project_id").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))
        return totals.select("project_id", "n_docs", (F.col("total_len") / F.col("n_docs")).alias("avg_len"))

    def term_rows(self, asked: DataFrame, dead: DataFrame | None = None) -> DataFrame:
        """(project_id, term, segment, block, slot, gain, n_docs) of the rows that hold a term in name or content."""
        hits = self._postings(asked, True, dead).select("project_id", "term", "segment", "block", "occurrences", F.explode("entries").alias("e"))
        rows = hits.groupBy("project_id", "term", "segment", "block", "e.slot", "e.len").agg(F.sum(F.col("occurrences") * F.col("e.tf")).alias("tf"))
        return rows.join(self._stats(dead), "project_id").select(
            "project_id", "term", "segment", "block", "slot", S._gain(F.col("tf"), F.col("len"), F.col("avg_len")).alias("gain"), "n_docs")

    def plan_blocks(self, terms: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Term weights (query_id, project_id, term, needed, idf), and for each query its blocks in the order of their bounds:
        (query_id, segment, block, bound, place). ``rows``: of ``term_rows``."""
        blocks = cut_lineage(rows.groupBy("segment", "project_id", "term", "block").agg(
            F.count("*").alias("rows"), F.max("gain").alias("gain"), F.first("n_docs").alias("n_docs")))
        counts = blocks.groupBy("project_id", "term").agg(F.sum("rows").alias("doc_freq"), F.first("n_docs").alias("n_docs"))
        weights = terms.join(counts, ["project_id", "term"]).select(
            "query_id", "project_id", "term", "needed", S._idf(F.col("n_docs"), F.col("doc_freq")).alias("idf"))
        found = blocks.join(weights, ["project_id", "term"]).groupBy("query_id", "needed", "segment", "block").agg(
            F.sum(F.col("idf") * F.col("gain")).alias("bound"), F.count("*").alias("found")).where("found >= needed")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block")
        return weights, found.select("query_id", "segment", "block", "bound", F.row_number().over(order).alias("place"))

    def _scored(self, chosen: DataFrame, weights: DataFrame, rows: DataFrame) -> DataFrame:
        """(query_id, segment, row, score) of the rows of the chosen blocks that hold the needed terms."""
        asked = chosen.select("query_id", "segment", "block").join(weights, "query_id")
        out = rows.join(asked, ["project_id", "term", "segment", "block"]).groupBy("query_id", "needed", "segment", "block", "slot").agg(
            F.sum(-F.col("idf") * F.col("gain")).alias("score"), F.count("*").alias("found"))
        row = F.shiftleft("block", BLOCK_BITS).bitwiseOR(F.col("slot").cast("bigint"))
        return out.where("found >= needed").select("query_id", "segment", row.alias("row"), "score")

    def _described(self, scored: DataFrame, planned: DataFrame, filters: bool, columns: list[str]) -> DataFrame:
        """Scored rows with the columns of their chunks and the query's limit; those that the query's filters reject are gone."""
        lean = self.read("rows").select("segment", "row", *dict.fromkeys([*S.CHUNK_KEY, "lang", *columns]))
        rows = scored.join(lean, ["segment", "row"]).join(planned.select("query_id", "n", "type_filter", "file_filter", "lang_filter"), "query_id")
        if filters:
            rows = rows.where(
                (F.col("type_filter").isNull() | (F.col("type") == F.col("type_filter")))
                & (F.col("file_filter").isNull() | F.contains("file", "file_filter"))
                & (F.col("lang_filter").isNull() | (F.col("lang") == F.col("lang_filter"))))
        return rows.drop("type_filter", "file_filter", "lang_filter")

    def reaching(self, blocks: DataFrame, first: DataFrame) -> DataFrame:
        """The blocks after the first wave that may still hold one of the query's best n rows; ``first``: the described rows of that wave."""
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("score"))
        bar = first.select("query_id", "n", "score").withColumn("k", nth).where("k = n").select("query_id", F.col("score").alias("bar"))
        later = blocks.where(F.col("place") > WAVE).join(bar, "query_id", "left")
        return later.where(F.col("bar").isNull() | (-F.col("bound") <= F.col("bar") + NEAR)).drop("bar")

    def _front(self, wide: DataFrame, dead: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(query_id, segment, row) for wide(query_id, project_id, n, term) that the first rows of their projects settle, and their query_id.

        Rows without a score count in order of place. So a query is settled if n rows among the first ones hold a word of it, or if these
        are all rows of the project, whatever else the index holds: frequent words, whose postings are long, end here.
        """
        lean = self.read("rows").select("project_id", "segment", "row", *PLACE)
        if dead is not None:
            gone = F.shiftleft("block", BLOCK_BITS).bitwiseOR(F.col("slot").cast("bigint"))
            lean = lean.join(dead.select("segment", gone.alias("row")), ["segment", "row"], "left_anti")
        first = cut_lineage(top_k_per_group(lean, ["project_id"], [F.asc(c) for c in PLACE], FRONT[-1], "place").select("project_id", "segment", "row", "place"))
        sizes = first.groupBy("project_id").agg(F.count("*").alias("size"))
        keys = first.select("segment", "row", "place")
        keys = F.broadcast(keys) if keys.count() <= ROW_LIMIT else keys
        texts = S._lowered(self.read("rows").select("project_id", "segment", "row", "name", "content", "body").join(keys, ["segment", "row"]), body=True)
        texts = cut_lineage(texts.select("project_id", "segment", "row", "place", "_name", "_content", "_body").withColumn("_slice", F.col("place") % SLICES))
        # Short words are held by most rows, so they come first.
        asked = wide.groupBy("query_id", "project_id", "n").agg(F.sort_array(F.collect_list(F.struct(F.length("term").alias("len"), "term"))).alias("words"))
        left = cut_lineage(asked.select("query_id", "project_id", "n", F.col("words.term").alias("words")).join(sizes, "project_id"))
        rows = settled = None
        for places in FRONT:
            spread = left.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
            hits = texts.where(F.col("place") <= places).join(spread, ["project_id", "_slice"]).where(F.exists("words", S._inside(("_name", "_content", "_body"))))
            hits = hits.select("query_id", "n", "segment", "row", "place")
            top = cut_lineage(top_k_per_group(hits, ["query_id"], [F.asc("place")], MAP_SIDE_LIMIT).where("rank <= n"))
            full = top.groupBy("query_id", "n").agg(F.count("*").alias("found")).where("found = n").select("query_id")
            done = cut_lineage(full.union(left.where(F.col("size") < places).select("query_id")).distinct())
            got = top.join(done, "query_id", "left_semi").select("query_id", "segment", "row")
            rows, settled = (got, done) if rows is None else (rows.unionByName(got), settled.unionByName(done))
            left = cut_lineage(left.join(done, "query_id", "left_anti"))
        return rows, settled

    def _fallback(self, words: DataFrame, dead: DataFrame | None) -> DataFrame:
        """(query_id, segment, row, score 0) of the rows that hold any of a query's words(query_id, project_id, n, narrow, term) anywhere.

        Of such rows the first ones by place count. Where no filter of the query comes in between, the first rows of the project settle most
        queries; for the others, these are among the first of each word, so a word's rows are cut before its queries are looked at.
        """
        settled, ids = self._front(words.where("not narrow"), dead)
        settled = settled.withColumn("score", F.lit(0.0))
        words = cut_lineage(words.join(ids, "query_id", "left_anti"))
        if words.isEmpty():
            return settled
        most = words.agg(F.max("n")).first()[0]
        row = F.shiftleft("block", BLOCK_BITS).bitwiseOR(F.col("e.slot").cast("bigint"))
        held = self._postings(self._words_of(words), False, dead).select("project_id", "term", "segment", "block", F.explode("entries").alias("e"))
        held = held.select("project_id", "term", "segment", row.alias("row")).distinct()
        every = held.join(words.where("narrow"), ["project_id", "term"])
        wide = words.where("not narrow")
        placed = held.join(wide.select("project_id", "term").distinct(), ["project_id", "term"], "left_semi").join(
            self.read("rows").select("segment", "row", *PLACE), ["segment", "row"])
        first = top_k_per_group(placed, ["project_id", "term"], [F.asc(c) for c in PLACE], most)
        out = every.select("query_id", "segment", "row").unionByName(first.join(wide, ["project_id", "term"]).select("query_id", "segment", "row"))
        return out.distinct().withColumn("score", F.lit(0.0)).unionByName(settled)

    def search(self, queries: DataFrame, ranked: bool = True, filters: bool = True, payload: tuple[str, ...] = ("line_end", "lang"),
               within: str | None = None, live: DataFrame | None = None, segments: list[str] | None = None) -> DataFrame:
        """As ``search.search``. ``live`` (segment, project_id, file): the segment that counts for a file; without it all rows of the
        segments do."""
        if segments is not None:
            return PostingIndex(self.spark, self.root, segments).search(queries, ranked, filters, payload, within, live)
        if within is None:
            planned = S.plan_queries(queries)
        else:
            planned = S.plan_queries(queries.withColumnRenamed(within, "_within")).withColumns({
                "file_filter": F.col("_within"), "type_filter": F.lit(None).cast("string"), "lang_filter": F.lit(None).cast("string"),
            }).drop("_within")
            filters = True
        planned = cut_lineage(planned)
        columns = [c for c in payload if c not in S.CHUNK_KEY and c != "body"]
        dead = self._dead(live)
        terms = S._query_terms(planned)
        held = cut_lineage(self.term_rows(self._words_of(terms), dead))
        weights, blocks = self.plan_blocks(terms, held)
        if ranked:
            blocks = cut_lineage(blocks)
            first = cut_lineage(self._scored(blocks.where(F.col("place") <= WAVE), weights, held))
            more = self.reaching(blocks, self._described(first, planned, filters, []))
            scored = cut_lineage(first.unionByName(self._scored(more, weights, held)))
        else:
            scored = cut_lineage(self._scored(blocks, weights, held).withColumn("score", F.lit(0.0)))
        open_queries = planned.where(F.size("fallback") > 0).join(scored.select("query_id").distinct(), "query_id", "left_anti")
        narrow = F.lit(filters) & (F.col("type_filter").isNotNull() | F.col("file_filter").isNotNull() | F.col("lang_filter").isNotNull())
        words = cut_lineage(open_queries.select("query_id", "project_id", "n", narrow.alias("narrow"), F.explode("fallback").alias("term")))
        if not words.isEmpty():
            scored = scored.unionByName(self._fallback(words, dead))
        rows = self._described(scored, planned, filters, columns).select("query_id", *S.CHUNK_KEY, "score", *columns, "n", "segment", "row")
        top = S._top(rows).drop("n")
        if "body" in payload:  # by row number, for results only
            top = cut_lineage(top).join(self.read("rows").select("segment", "row", "body"), ["segment", "row"])
        return top.drop("segment", "row")
