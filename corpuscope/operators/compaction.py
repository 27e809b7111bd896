"""Compaction of tool outputs.

A tool output is one row, and everything compaction needs lies in that row, so all of it is
column expressions: no explode, no shuffle, no Python. A job over any number of logs is a single
scan. Regular expressions see the whole text; arrays are only built for texts in which a cheap
test has found something to do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope import dims
from corpuscope.functions import columns as C

# Escape sequences, stack frames, counters and failure lines.
ANSI_RE = r"\x1B\[[0-9;]*[A-Za-z]|\x1B\][^\x07]*\x07"
FRAME_RE = r'(?md)^(?= )(?=[^\S\n]*at[^\S\n]|[^\S\n]*File[^\S\n]+"|[^:\n]+:\d+:)[^\S\n]+'
RUN_OF_THREE_RE = r"(?:^|(?<=\n))([^\n]*+)\n\1\n\1(?=\n|\z)"
COUNTERS = ("passed", "failed", "skipped", "error")
FAILURE_RE = (
    r"(?imd)^[^\n]*?(?:FAIL|✗|Error|error:|(?<![A-Za-z0-9_])F(?![A-Za-z0-9_]))"
    r"[^\S\n]*[:\-]?[^\S\n]*([^\n\r  ]{0,150})[^\n]*"
)
ERROR_NAME_RE = r"^([A-Z][A-Za-z]*Error)"
GREP_PREFIX_RE = r"(?md)^([^\n\r]+?):[^\n]*"
TEXT_LINE_RE = r"(?md)^[^\n]*?\S[^\n]*"
SUMMARY_TAG = "[semantic compress]"
# The label names what left the text out; outputs are compared by it.
OMITTED_BY = "output compaction"


def strip_ansi(text: C.ColumnLike) -> Column:
    c = C.col(text)
    return F.when(c.contains("\x1b"), F.regexp_replace(c, ANSI_RE, "")).otherwise(c)


def trim_stack_frames(text: C.ColumnLike) -> Column:
    """Drop the indent of lines that look like stack frames."""
    return F.regexp_replace(C.col(text), FRAME_RE, "")


def _collapse(lines: Column) -> Column:
    islands = C.runs(lines, lambda a, b: a == b)
    kept = F.flatten(
        F.transform(
            islands,
            lambda r: F.when(r.n >= 3, F.array(F.concat(r.item, F.lit(" (x"), r.n, F.lit(")"))))
            .otherwise(F.array_repeat(r.item, r.n)),
        )
    )
    return F.array_join(kept, "\n")


def collapse_runs(text: C.ColumnLike) -> Column:
    """Runs of three or more equal lines become ``line (xN)``; texts under five lines stay."""
    c = C.col(text)
    has_run = (C.line_count(c) >= 5) & c.rlike(RUN_OF_THREE_RE)
    return F.when(has_run, C.let(C.lines_of(c), _collapse)).otherwise(c)


def preprocess(df: DataFrame, text: str, ansi: bool = True, stack: bool = True, dedupe: bool = True) -> DataFrame:
    """Adds ``clean`` and ``pre_saved``; each step can be switched off."""
    c: Column = F.col(text)
    if ansi:
        c = strip_ansi(c)
    if stack:
        c = trim_stack_frames(c)
    if dedupe:
        c = C.let(c, collapse_runs)
    return df.withColumn("clean", c).withColumn("pre_saved", F.length(text) - F.length("clean"))


def max_lines(tool: C.ColumnLike, overrides: dict[str, int] | None = None) -> Column:
    return C.lookup(tool, {**dims.TOOL_MAX_LINES, **(overrides or {})}, dims.DEFAULT_MAX_LINES)


def max_chars(tool: C.ColumnLike) -> Column:
    return C.lookup(tool, dims.TOOL_MAX_CHARS, dims.DEFAULT_MAX_CHARS)


def _marker(n: Column, unit: str) -> Column:
    return F.concat(F.lit("\n[... "), n, F.lit(f" {unit} omitted by {OMITTED_BY}]"))


def _structural(df: DataFrame, tool: str, text: str, overrides: dict[str, int] | None) -> DataFrame:
    """Line cap, then character cap, over ``clean``; adds ``out`` and ``out_method``."""
    df = (
        df.withColumn("_lines", C.line_count("clean"))
        .withColumn("_max_lines", max_lines(tool, overrides))
        .withColumn("_max_chars", max_chars(tool))
    )
    over = F.col("_lines") > F.col("_max_lines")
    kept = F.when(
        over,
        F.concat(
            F.call_function("substring_index", F.col("clean"), F.lit("\n"), F.col("_max_lines")),
            F.lit("\n"),
            _marker(F.col("_lines") - F.col("_max_lines"), "lines"),
        ),
    ).otherwise(F.col("clean"))
    cut = C.let(
        kept,
        lambda k: F.when(
            F.length(k) > F.col("_max_chars"),
            F.concat(
                F.substr(k, F.lit(1), F.col("_max_chars")),
                _marker(F.length("clean") - F.col("_max_chars"), "chars"),
            ),
        ).otherwise(k),
    )
    untouched = (~over) & (F.col("pre_saved") == 0) & (F.length("clean") <= F.col("_max_chars"))
    return (
        df.withColumn("out", F.when(untouched, F.col(text)).otherwise(cut))
        .withColumn(
            "out_method",
            F.when(untouched, "none").when(F.col("pre_saved") > 0, "combined").otherwise("truncate"),
        )
        .drop("_lines", "_max_lines", "_max_chars")
    )


def _counter(text: Column, word: str) -> Column:
    """Sum of the first ``N word`` of every line."""
    found = F.regexp_extract_all(
        text, F.lit(rf"(?md)^[^\n]*?(\d+)[^\S\n]+{word}[^\n]*"), F.lit(1)
    )
    total = F.aggregate(
        found, F.lit(0).cast("bigint"),
        lambda acc, v: acc + F.coalesce(v.try_cast("bigint"), F.lit(0).cast("bigint")),
    )
    return F.when(text.contains(word), total).otherwise(F.lit(0).cast("bigint"))


def _failure_type(tail: Column) -> Column:
    named = F.regexp_extract(tail, ERROR_NAME_RE, 1)
    head = F.substring(F.trim(F.substring_index(tail, ":", 1)), 1, 60)
    return F.when(named != "", named).when(head != "", head).otherwise("Error")


def failure_types(text: C.ColumnLike) -> Column:
    """Failure types of a log as ``array<struct<n, first, type>>``, most frequent first.

    Sort, then measure runs: n log n in the number of failure lines, inside the row.
    """
    tails = F.filter(F.regexp_extract_all(C.col(text), F.lit(FAILURE_RE), F.lit(1)), lambda t: t != "")
    typed = F.transform(tails, lambda t, i: F.struct(_failure_type(t).alias("type"), i.alias("pos")))
    by_type = C.let(F.array_sort(typed), lambda s: C.runs(s, lambda a, b: a.type == b.type))
    counted = F.transform(
        by_type,
        lambda r: F.struct((-r.n).alias("neg"), r.item.pos.alias("first"), r.item.type.alias("type")),
    )
    return F.when(F.size(tails) > 0, F.array_sort(counted)).otherwise(
        F.array().cast("array<struct<neg:int,first:int,type:string>>")
    )


def test_summary(text: C.ColumnLike) -> Column:
    """Counts of passed, failed, skipped and error lines, with the five main failure types."""
    c = C.col(text)
    counts = F.array(*[_counter(c, w) for w in COUNTERS])
    names = C.literal_array(COUNTERS)

    def render(values: Column) -> Column:
        parts = F.filter(
            F.zip_with(values, names, lambda v, w: F.when(v != 0, F.concat(v, F.lit(" "), w))),
            lambda p: p.isNotNull(),
        )
        head = F.concat(F.lit(f"{SUMMARY_TAG} Tests: "), F.array_join(parts, ", "))

        def with_types(types: Column) -> Column:
            top = F.transform(
                F.slice(types, 1, 5),
                lambda t: F.concat(F.lit("- "), t.type, F.lit(": "), -t.neg, F.lit("x")),
            )
            more = F.when(
                F.size(types) > 5,
                F.concat(F.lit("\n... ("), F.size(types) - 5, F.lit(" more error types)")),
            ).otherwise("")
            return F.when(
                F.size(types) > 0,
                F.concat(head, F.lit("\nFailure types:\n"), F.array_join(top, "\n"), more),
            ).otherwise(head)

        return F.when(F.exists(values, lambda v: v != 0), C.let(failure_types(c), with_types))

    return C.let(counts, render)


def grep_summary(text: C.ColumnLike) -> Column:
    c = C.col(text)
    files = F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(GREP_PREFIX_RE), F.lit(1))))
    return C.let(
        files,
        lambda n: F.when(
            n > 0,
            F.concat(F.lit(f"{SUMMARY_TAG} grep: "), C.line_count(c), F.lit(" matches in "), n, F.lit(" files")),
        ),
    )


def glob_summary(text: C.ColumnLike) -> Column:
    return C.let(
        F.regexp_count(C.col(text), F.lit(TEXT_LINE_RE)),
        lambda n: F.when(n > 0, F.concat(F.lit(f"{SUMMARY_TAG} "), n, F.lit(" files"))),
    )


def semantic_summary(tool: C.ColumnLike, text: C.ColumnLike) -> Column:
    """Summary of a whole output by tool family; null where none applies."""
    t = C.col(tool)
    return F.when(
        C.line_count(text) >= 3,
        F.when(t.isin(*dims.SHELL_TOOLS, *dims.TEST_TOOLS), test_summary(text))
        .when(t.isin(*dims.GREP_TOOLS), grep_summary(text))
        .when(t.isin(*dims.GLOB_TOOLS), glob_summary(text)),
    )


def is_compressible(tool: C.ColumnLike) -> Column:
    return C.col(tool).isin(*dims.TOOL_MAX_LINES)


def is_client_compressible(tool: C.ColumnLike) -> Column:
    t = C.col(tool)
    return t.isin(*dims.CLIENT_TOOLS) | t.startswith("bash") | t.startswith("sh")


def exceeds_threshold(text: C.ColumnLike, threshold: int = dims.COMPACTION_THRESHOLD) -> Column:
    return F.length(C.col(text)) > threshold


def compact(
    outputs: DataFrame,
    tool: str = "tool_id",
    text: str = "output",
    semantic: bool = False,
    ansi: bool = True,
    stack: bool = True,
    dedupe: bool = True,
    line_overrides: dict[str, int] | None = None,
) -> DataFrame:
    """Adds ``compacted``, ``method``, ``original_len``, ``compressed_len``, ``tokens_saved``.

    With ``semantic`` a summary replaces the text where one applies; elsewhere the structural
    steps run.
    """
    df = _structural(preprocess(outputs, text, ansi, stack, dedupe), tool, text, line_overrides)
    if semantic:
        cleaned = strip_ansi(text) if ansi else F.col(text)
        df = df.withColumn("_summary", C.let(cleaned, lambda c: semantic_summary(tool, c)))
        summarised = F.col("_summary").isNotNull()
        df = df.withColumn("compacted", F.when(summarised, F.col("_summary")).otherwise(F.col("out")))
        df = df.withColumn("method", F.when(summarised, "semantic").otherwise(F.col("out_method")))
        df = df.drop("_summary")
    else:
        df = df.withColumn("compacted", F.col("out")).withColumn("method", F.col("out_method"))
    df = df.withColumn("original_len", F.length(text)).withColumn("compressed_len", F.length("compacted"))
    saved = F.when(F.col("method") == "none", F.lit(0).cast("bigint")).otherwise(
        C.estimate_tokens(F.col("original_len") - F.col("compressed_len"))
    )
    results = {c: F.col(c) for c in ("compacted", "method", "original_len", "compressed_len")}
    kept = [c for c in outputs.columns if c not in (*results, "tokens_saved")]
    return C.pinned(df, **results, tokens_saved=saved).select(*kept, *results, "tokens_saved")


def substitute(df: DataFrame, original: str, replacement: str) -> DataFrame:
    """Use a replacement only where it is shorter; adds ``result``, ``substituted``, ``tokens_saved``."""
    shorter = F.col(replacement).isNotNull() & (F.col(replacement) != "") & (
        F.length(replacement) < F.length(original)
    )
    return (
        df.withColumn("substituted", shorter)
        .withColumn("result", F.when(shorter, F.col(replacement)).otherwise(F.col(original)))
        .withColumn(
            "tokens_saved",
            C.estimate_tokens(F.length(original) - F.length("result")),
        )
    )


def substitute_string(original: C.ColumnLike, replacement: C.ColumnLike) -> Column:
    """The replacement, cut to the length of the original."""
    o, r = C.col(original), C.col(replacement)
    return F.when(F.length(r) <= F.length(o), r).otherwise(F.substr(r, F.lit(1), F.length(o)))


def response_text(tool_name: C.ColumnLike, read: str, shell: str) -> Column:
    """The one free-text field of a structured response (null for other tools)."""
    t = C.col(tool_name)
    return F.when(t == "Read", F.col(f"{read}.file.content")).when(t == "Bash", F.col(f"{shell}.stdout"))


def rebuild_read_response(response: str, text: C.ColumnLike) -> Column:
    """Swap the content of a file response and recount its lines; other fields stay."""
    t = C.col(text)
    return F.when(
        F.col(f"{response}.file").isNotNull(),
        F.col(response).withField("file.content", t).withField("file.numLines", C.line_count(t).cast("int")),
    )


def rebuild_shell_response(response: str, text: C.ColumnLike) -> Column:
    return F.when(F.col(response).isNotNull(), F.col(response).withField("stdout", C.col(text)))


def compaction_events(compacted: DataFrame, project: Column, semantic: bool = True) -> DataFrame:
    """Usage events of a compaction job: one per output that saved tokens."""
    from corpuscope.operators.usage import append_events

    return append_events(
        compacted.filter(F.col("tokens_saved") > 0),
        project, F.lit("compression"), F.col("tokens_saved"),
        meta=F.struct(
            F.col("tool_id").alias("toolID"), "method", F.lit(semantic).alias("semantic")
        ),
        ts=F.col("ts"),
    )
