"""Text rendering of search results, snippets and reference lists.

Rows are only gathered per query (at most 200 results) or per file after the cut to the rows
that are shown.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions import columns as C
from corpuscope.operators.ranking import top_k_per_group

DEFAULT_SNIPPET_LINES = 12
GROUP_FROM = 5
SNIPPET_CHUNKS = 5
MAX_BODY_LINES = 15
MAX_REFERENCE_FILES = 50


def ordered_join(order: list[str], text: str, sep: str) -> Column:
    """String aggregate in a stated order."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return F.array_join(F.transform(items, lambda r: r["_text"]), sep)


def line_range(line: str = "line", line_end: str = "line_end") -> Column:
    return F.when(F.col(line_end) > F.col(line), F.concat(line, F.lit("-"), line_end)).otherwise(
        F.col(line).cast("string")
    )


def snippet(body: C.ColumnLike, start: C.ColumnLike, max_lines: int = DEFAULT_SNIPPET_LINES) -> Column:
    """First and last lines of a body with line numbers; numbers run on after the elision."""
    head = math.ceil(max_lines * 0.7)
    tail = max_lines - head

    def shown(lines: Column) -> Column:
        n = F.size(lines)
        elision = F.concat(F.lit("… ("), n - head - tail, F.lit(" more lines) …"))
        last = F.slice(lines, n - tail + 1, F.lit(tail)) if tail else F.array().cast("array<string>")
        return F.when(n <= max_lines, lines).otherwise(F.concat(F.slice(lines, 1, head), F.array(elision), last))

    def numbered(lines: Column) -> Column:
        def mark(line: Column) -> Column:
            return line.startswith("…") & line.endswith("…")

        def one(line: Column, i: Column) -> Column:
            # At most max_lines + 1 lines are shown, so counting marks before i is cheap.
            marks = F.size(F.filter(F.slice(lines, F.lit(1), i), mark))
            number = (C.col(start) + i - marks).cast("string")
            padded = F.when(F.length(number) < 3, F.lpad(number, 3, " ")).otherwise(number)
            return F.when(mark(line), F.concat(F.lit("   │ "), line)).otherwise(F.concat(padded, F.lit("│ "), line))

        return F.array_join(F.transform(lines, one), "\n")

    return F.when(
        C.col(body) != "", C.let(C.let(C.lines_of(body), shown), numbered)
    ).otherwise("")


def result_text(root: C.ColumnLike, compact: bool = False, snippet_lines: int = DEFAULT_SNIPPET_LINES) -> Column:
    """One result: ``type name @ path:range`` and its snippet."""
    head = F.concat(
        "type", F.lit(" "), "name", F.lit(" @ "), C.relative_path(root, "file"), F.lit(":"), line_range()
    )
    if compact:
        return head
    return C.let(
        snippet("body", "line", snippet_lines),
        lambda s: F.when(s != "", F.concat(head, F.lit("\n"), s)).otherwise(head),
    )


def result_page(
    results: DataFrame,
    root: Column,
    compact: bool = False,
    snippet_lines: int = DEFAULT_SNIPPET_LINES,
    grouped: bool | None = None,
) -> DataFrame:
    """One text per query; five or more results are grouped by file in order of first rank."""
    head = F.concat(F.lit("  "), "type", F.lit(" "), "name", F.lit(" @ "), line_range())
    if compact:
        in_file = head
    else:
        indented = F.regexp_replace(snippet("body", "line", snippet_lines), r"(?d)(^|\n)", "$1  ")
        in_file = C.let(
            F.when(F.col("body") != "", indented).otherwise(""),
            lambda s: F.when(s != "", F.concat(head, F.lit("\n"), s)).otherwise(head),
        )
    per_query = Window.partitionBy("query_id")
    rows = results.select(
        "query_id", "rank", "file",
        F.count(F.lit(1)).over(per_query).alias("_n"),
        result_text(root, compact, snippet_lines).alias("_flat"),
        in_file.alias("_in_file"),
        C.relative_path(root, "file").alias("_rel"),
    )
    files = rows.groupBy("query_id", "file").agg(
        F.min("rank").alias("_first"), F.first("_rel").alias("_rel"), F.first("_n").alias("_n"),
        ordered_join(["rank"], "_in_file", "\n").alias("_rows"),
        F.sort_array(F.collect_list(F.struct("rank", "_flat"))).alias("_flat"),
    ).withColumn("_block", F.concat("_rel", F.lit("\n"), "_rows"))
    use_groups = F.lit(grouped) if grouped is not None else F.first("_n") >= GROUP_FROM
    flat = F.array_join(
        F.transform(F.array_sort(F.flatten(F.collect_list("_flat"))), lambda r: r["_flat"]), "\n\n"
    )
    return files.groupBy("query_id").agg(
        F.when(use_groups, ordered_join(["_first"], "_block", "\n")).otherwise(flat).alias("text")
    )


def file_snippets(
    chunks: DataFrame, keys: list[str], root: Column, max_body_lines: int = MAX_BODY_LINES, cap_body: bool = True
) -> DataFrame:
    """Per key (a file or a read request): its first five chunks, bodies capped, and a trailer."""
    order = [F.asc("line"), F.asc("name"), F.asc("type")]
    counts = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    first = top_k_per_group(chunks, keys, order, SNIPPET_CHUNKS)
    head = F.concat("type", F.lit(" "), "name", F.lit(" @ "), C.relative_path(root, "file"), F.lit(":"), line_range())
    n_lines = C.line_count("body")
    body = F.when(
        n_lines > max_body_lines,
        F.concat(
            F.substring_index("body", "\n", max_body_lines), F.lit("\n[... "), n_lines - max_body_lines,
            F.lit(" more lines]"),
        ),
    ).otherwise(F.col("body"))
    shown = F.when(F.col("body") != "", F.concat(head, F.lit("\n"), body)).otherwise(head) if cap_body else head
    texts = first.withColumn("_shown", shown).groupBy(*keys).agg(ordered_join(["rank"], "_shown", "\n").alias("_text"))
    trailer = F.when(
        F.col("_n") > SNIPPET_CHUNKS,
        F.concat(
            F.lit("\n["), F.col("_n") - SNIPPET_CHUNKS,
            F.lit(" more chunks omitted. Use offset/limit to see more.]"),
        ),
    ).otherwise("")
    return texts.join(counts, keys).select(*keys, F.concat("_text", trailer).alias("text"))


def reference_text(refs: DataFrame, keys: list[str], impact: bool = False) -> DataFrame:
    """Compact list of related symbols (or dependents) per key, one line per file.

    refs: keys, seq-free columns file (or dependent), kind, symbol, direction. Each file lists a
    (kind, symbol) once; past 50 files a closing line says how many are left out.
    """
    file = "dependent" if impact else "file"
    unique = refs.groupBy(*keys, file, "kind", "symbol").agg(
        (F.lit(None).cast("string") if impact else F.max("direction")).alias("direction")
    )
    label = F.concat(
        "kind", F.lit("->"), "symbol",
        F.when(F.col("direction").isNotNull(), F.concat(F.lit(" ("), "direction", F.lit(")"))).otherwise(""),
    )
    lines = unique.withColumn("_label", label).groupBy(*keys, file).agg(
        F.array_join(F.array_sort(F.collect_set("_label")), ", ").alias("_refs")
    )
    counts = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    top = top_k_per_group(lines, keys, [F.asc(file)], MAX_REFERENCE_FILES)
    texts = top.withColumn("_line", F.concat(file, F.lit(": "), "_refs")).groupBy(*keys).agg(
        ordered_join(["rank"], "_line", "\n").alias("_text")
    )
    more = F.when(
        F.col("_n") > MAX_REFERENCE_FILES,
        F.concat(F.lit("\n[... "), F.col("_n") - MAX_REFERENCE_FILES, F.lit(" more files with refs]")),
    ).otherwise("")
    return texts.join(counts, keys).select(*keys, F.concat("_text", more).alias("text"))
