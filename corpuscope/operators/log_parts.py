"""Compaction of logs that come in parts.

A log too long for one row is a sequence of parts, each some whole lines of it. Every part is cleaned and cut into runs of equal lines by
itself; its first and last run stay open. Open runs of neighbouring parts that hold the same line become one, which belongs to
the part where it begins. Counts of lines and characters before each part then tell which parts reach into the caps, and only
those give text. The result for a log is that of ``compaction.compact`` on the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope import dims
from corpuscope.functions import columns as C
from corpuscope.operators import compaction as K

#: Runs from this length on become one line, in logs of at least so many lines.
RUN, LEAST_LINES = 3, 5


def _cleaned(text: Column) -> Column:
    return K.trim_stack_frames(K.strip_ansi(text))


def merged_runs(parts: DataFrame, log: str = "log_id", part: str = "part", text: str = "text") -> DataFrame:
    """(log, part, runs, raw, raw_len) where ``runs`` (array of line and number) are those that begin in the part, with their whole length, and ``raw`` is the text of parts that fit the caps.

    Between tasks go two lines a part: the window over a log's parts sees these only.
    """
    base = parts.select(
        F.col(log).alias("log"), F.col(part).alias("part"), F.length(text).cast("bigint").alias("raw_len"),
        F.when(F.length(text) <= max(dims.DEFAULT_MAX_CHARS, *dims.TOOL_MAX_CHARS.values()), F.col(text)).alias("raw"),
        C.let(_cleaned(F.col(text)), lambda t: F.transform(
            C.runs(C.lines_of(t), lambda a, b: a == b), lambda r: F.struct(r.item.alias("line"), r.n.cast("bigint").alias("n")))).alias("runs"))
    order = Window.partitionBy("log").orderBy("part")
    ends = base.select("log", "part", F.size("runs").alias("k"), F.element_at("runs", 1).alias("head"), F.element_at("runs", -1).alias("tail"))
    ends = ends.withColumn("joined", F.coalesce(F.lag("tail").over(order)["line"] == F.col("head.line"), F.lit(False)))
    ends = ends.withColumn("group", F.sum(((F.col("k") > 1) | ~F.col("joined")).cast("bigint")).over(order))
    own = ends.select("log", "group", "part", F.col("tail.n").alias("n"))
    before = ends.filter("joined and k > 1").select("log", (F.col("group") - 1).alias("group"), F.lit(None).cast(base.schema["part"].dataType).alias("part"), F.col("head.n"))
    whole = own.unionByName(before).groupBy("log", "group").agg(F.sum("n").alias("n"), F.min("part").alias("part"))
    facts = ends.join(whole.select("log", "part", F.col("n").alias("tail_n")), ["log", "part"], "left").select("log", "part", "joined", "tail_n")
    none = F.array().cast("array<struct<line:string,n:bigint>>")
    k = F.size("runs")
    held = F.concat(
        F.when(~F.col("joined") & (k > 1), F.slice("runs", 1, 1)).otherwise(none),
        F.when(k > 2, F.slice("runs", F.lit(2), k - 2)).otherwise(none),
        F.when(F.col("tail_n").isNotNull(), F.array(F.struct(F.element_at("runs", -1)["line"].alias("line"), F.col("tail_n").alias("n")))).otherwise(none))
    return base.join(facts, ["log", "part"]).select("log", "part", "raw", "raw_len", held.alias("runs"))


def compact_parts(parts: DataFrame, tool: str = "tool_id", log: str = "log_id", part: str = "part", text: str = "text",
                  line_overrides: dict[str, int] | None = None) -> DataFrame:
    """(log, tool, compacted, method, original_len, compressed_len, tokens_saved) for each log of parts(log, tool, part, text).

    Lines of the parts follow each other in the order of ``part``; escape sequences don't reach over the end of a part. Null texts are left
    out. A log of any number of parts gathers no more than the lines and characters that its caps let through.
    """
    parts = parts.filter(F.col(text).isNotNull())
    runs = merged_runs(parts, log, part, text)
    tools = parts.groupBy(F.col(log).alias("log")).agg(F.min(tool).alias("tool"))
    n = lambda r: r["n"]
    order = Window.partitionBy("log").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    raw = runs.groupBy("log").agg(F.sum(F.aggregate("runs", F.lit(0).cast("bigint"), lambda acc, r: acc + n(r))).alias("raw_lines"))
    sized = runs.join(raw, "log").join(tools, "log")
    folds = lambda r: (n(r) >= RUN) & (F.col("raw_lines") >= LEAST_LINES)
    note = lambda r: F.concat(F.lit(" (x"), n(r), F.lit(")"))
    lines = F.aggregate("runs", F.lit(0).cast("bigint"), lambda acc, r: acc + F.when(folds(r), 1).otherwise(n(r)))
    chars = F.aggregate("runs", F.lit(0).cast("bigint"), lambda acc, r: acc + F.when(
        folds(r), F.length(r["line"]) + F.length(note(r)) + 1).otherwise(n(r) * (F.length(r["line"]) + 1)))
    sized = sized.withColumn("lines", lines).withColumn("chars", chars).withColumn("max_lines", K.max_lines("tool", line_overrides).cast("bigint"))
    sized = sized.withColumn("max_chars", K.max_chars("tool").cast("bigint"))
    sized = sized.withColumn("lines_before", F.coalesce(F.sum("lines").over(order), F.lit(0))).withColumn(
        "chars_before", F.coalesce(F.sum("chars").over(order), F.lit(0))).withColumn(
        "raw_before", F.coalesce(F.sum(F.col("raw_len") + 1).over(order), F.lit(0)))
    reach = (F.col("lines_before") < F.col("max_lines")) & (F.col("chars_before") <= F.col("max_chars") + 1)
    room = F.col("max_lines") - F.col("lines_before")
    shown = F.slice(F.flatten(F.transform("runs", lambda r: F.when(folds(r), F.array(F.concat(r["line"], note(r)))).otherwise(
        F.array_repeat(r["line"], F.least(n(r), room).cast("int"))))), F.lit(1), room.cast("int"))
    text_ = F.substr(F.array_join(shown, "\n"), F.lit(1), (F.col("max_chars") + 1).cast("int"))
    piece = F.when(reach & (F.col("lines") > 0), F.struct("part", text_.alias("text")))
    given = F.when(F.col("raw_before") <= F.col("max_chars"), F.struct("part", "raw"))
    whole = sized.groupBy("log", "tool", "max_lines", "max_chars").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "\n").alias("head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(given)), lambda p: p["raw"]), "\n").alias("given"),
        F.sum("lines").alias("lines"), (F.sum("chars") - 1).alias("clean_len"), (F.sum(F.col("raw_len") + 1) - 1).alias("original_len"))
    over = F.col("lines") > F.col("max_lines")
    # Length of the lines within the cap is only needed where it is within the character cap, and then the head holds them all.
    kept = F.when(over, F.concat("head", F.lit("\n"), K._marker(F.col("lines") - F.col("max_lines"), "lines"))).otherwise(F.col("head"))
    cut = C.let(kept, lambda t: F.when(F.length(t) > F.col("max_chars"), F.concat(
        F.substr(t, F.lit(1), F.col("max_chars").cast("int")), K._marker(F.col("clean_len") - F.col("max_chars"), "chars"))).otherwise(t))
    saved = F.col("original_len") - F.col("clean_len")
    untouched = ~over & (saved == 0) & (F.col("clean_len") <= F.col("max_chars"))
    method = F.when(untouched, "none").when(saved > 0, "combined").otherwise("truncate")
    out = whole.withColumn("compacted", F.when(untouched, F.col("given")).otherwise(cut)).withColumn("method", method).withColumn("compressed_len", F.length("compacted").cast("bigint"))
    tokens = F.when(F.col("method") == "none", F.lit(0).cast("bigint")).otherwise(C.estimate_tokens(F.col("original_len") - F.col("compressed_len")))
    return out.select(F.col("log").alias(log), F.col("tool").alias(tool), "compacted", "method", "original_len", "compressed_len", tokens.alias("tokens_saved"))
