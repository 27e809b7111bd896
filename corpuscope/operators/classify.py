"""Classification of tool calls: which ones an index can serve, and about what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope import dims
from corpuscope.functions import columns as C
from corpuscope.operators.corpus import is_sensitive
from corpuscope.operators.graph import normalize_path

# Shell words; quoted parts belong to the word around them.
WORD_RE = r"""(?:[^ \t"']++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))++"""
QUOTES_RE = r"""(?s)"([^"]*)(?:"|\z)|'([^']*)(?:'|\z)"""
FILE_NAME_RE = r"\.\w+$"
REDUCED_READ_RE = r"^(?:cat|head|tail)\s+(\S+)"


# Argument names of tool calls.
ARGUMENTS = (
    "command", "cmd", "filePath", "path", "file_path", "pattern", "query", "glob", "url", "link", "term", "q",
)


def _with_arguments(calls: DataFrame) -> DataFrame:
    """Adds ``_a``, the call's known arguments: the JSON text is read once."""
    return calls.withColumn("_a", F.from_json("args", ", ".join(f"`{n}` STRING" for n in ARGUMENTS)))


def _arg(*names: str) -> Column:
    """First non-empty of the named arguments, or an empty text."""
    return F.coalesce(*[F.nullif(F.col(f"_a.{n}"), F.lit("")) for n in names], F.lit(""))


def _inside(project: Column, path: Column) -> Column:
    """Absolute path if it lies in the project, else null."""

    def full(p: Column) -> Column:
        return F.when(p.startswith("/"), p).otherwise(normalize_path(F.concat(project, F.lit("/"), p)))

    return C.let(
        path, lambda p: C.let(full(p), lambda f: F.when(f.startswith(project), f))
    )


def words(command: Column) -> Column:
    """Words of a command line without their quotes; empty words drop out."""
    raw = F.regexp_extract_all(command, F.lit(WORD_RE), F.lit(0))
    return F.filter(F.transform(raw, lambda w: F.regexp_replace(w, QUOTES_RE, "$1$2")), lambda w: w != "")


def _is_flag(word: Column) -> Column:
    return word.startswith("-") & ~word.rlike(r"^-\d") & ~word.rlike(FILE_NAME_RE)


def is_path(word: Column) -> Column:
    return word.rlike(FILE_NAME_RE) | word.contains("/")


def _first(array: Column, test) -> Column:
    return F.get(F.filter(array, test), F.lit(0))


def _tail(array: Column) -> Column:
    return F.slice(array, F.lit(2), F.greatest(F.size(array) - 1, F.lit(0)))


def classify_calls(
    calls: DataFrame, read: bool = True, grep: bool = True, home: str = "/root"
) -> DataFrame:
    """Adds ``kind``, ``path`` and ``query``; all null where the index cannot serve the call.

    calls(tool, args JSON, project_dir, ...). Each step is a column of its own, so that no
    expression is worked out twice.
    """
    tool, project = F.col("tool"), F.col("project_dir")
    command = F.regexp_replace(_arg("command", "cmd"), r"^\s+|\s+$", "")
    df = _with_arguments(calls).withColumn("_cmd", F.when(tool.isin(*dims.SHELL_TOOLS), command))
    df = df.withColumn("_head", F.regexp_extract("_cmd", r"^(\S*)", 1))
    rest = F.regexp_replace(F.substr("_cmd", F.length("_head") + 1), r"^\s+|\s+$", "")
    served = F.col("_head").isin(*dims.READ_COMMANDS, *dims.GREP_COMMANDS, "git", "jq")
    df = df.withColumn("_ops", F.when(served, F.filter(words(rest), lambda w: ~_is_flag(w))))

    head, ops = F.col("_head"), F.col("_ops")
    first, second = F.get(ops, F.lit(0)), F.get(ops, F.lit(1))
    git_read = (head == "git") & first.isin("show", "diff", "log")
    git_grep = (head == "git") & (first == "grep")
    searches = head.isin(*dims.GREP_COMMANDS)
    nothing = F.lit(None).cast("string")
    git_file = F.regexp_replace(
        _first(_tail(ops), lambda w: is_path(w) | w.rlike(r"^\S+:\S+")), r"^[^:]+:", ""
    )
    read_word = F.when(head.isin(*dims.READ_COMMANDS), _first(ops, is_path)).when(
        git_read, C.let(git_file, lambda g: F.when(is_path(g), g))
    )
    grep_word = F.when(searches | (head == "jq"), _first(_tail(ops), is_path)).when(
        git_grep, _first(_tail(_tail(ops)), is_path)
    )
    grep_query = (
        F.when(searches & ~first.startswith("-"), first)
        .when(git_grep & ~second.startswith("-"), second)
        .when(head == "jq", first)
    )
    word = F.when(tool == "read", _arg("filePath", "path") if read else nothing)
    df = (
        df.withColumn("_rword", read_word if read else nothing)
        .withColumn("_gquery", grep_query if grep else nothing)
        .withColumn("_gword", F.when(F.col("_gquery").isNotNull(), grep_word))
        .withColumn("_word", F.coalesce(word, "_rword", "_gword"))
    )
    unquoted = F.regexp_replace(F.regexp_replace("_word", "^~", home), r"^[\"']|[\"']$", "")
    df = df.withColumn(
        "_path", _inside(project, F.when(tool == "read", F.col("_word")).otherwise(unquoted))
    )
    # A read command whose path lies elsewhere is not a search, so the order below is safe.
    asked = F.nullif(
        F.when(tool == "grep", _arg("pattern", "query")).when(tool == "glob", _arg("pattern", "glob"))
        .when(tool == "websearch", _arg("query", "term", "q")).when(tool == "webfetch", _arg("url", "link")),
        F.lit(""),
    )
    df = df.withColumn("_asked", asked)
    has_path, has_text = F.col("_path").isNotNull(), F.col("_asked").isNotNull()
    kind = (
        F.when((tool == "read") & has_path, "read")
        .when(tool.isin("grep", "glob") & F.lit(grep) & has_text, tool)
        .when(tool.isin("webfetch", "websearch") & has_text, tool)
        .when(has_path & F.col("_rword").isNotNull(), "bash-read")
        .when(has_path & F.col("_gword").isNotNull(), "bash-grep")
    )
    df = df.withColumn("kind", F.when(F.coalesce(project, F.lit("")) != "", kind))
    path = F.when(F.col("kind") == "webfetch", F.col("_asked")).when(
        F.col("kind").isin("read", "bash-read", "bash-grep"), F.col("_path")
    )
    query = F.when(F.col("kind") == "bash-grep", F.col("_gquery")).when(
        F.col("kind").isin("grep", "glob", "websearch"), F.col("_asked")
    )
    done = C.pinned(df, kind=F.col("kind"), path=path, query=query)
    return done.select(*calls.columns, "kind", "path", "query")


def classify_reduced(calls: DataFrame, home: str = "/root") -> DataFrame:
    """The stricter classifier: Read and Bash only, sensitive paths never."""
    tool, cwd = F.col("tool"), F.col("project_dir")
    command = F.regexp_replace(_arg("command"), r"^\s+|\s+$", "")
    df = _with_arguments(calls).withColumn("_cmd", F.when(tool == "Bash", command))
    df = df.withColumn(
        "_raw", F.regexp_replace(F.regexp_extract("_cmd", REDUCED_READ_RE, 1), "^~", home)
    )
    shell_path = F.when(F.col("_raw").startswith("/"), F.col("_raw")).when(
        F.col("_raw") != "", normalize_path(F.concat(cwd, F.lit("/"), "_raw"))
    )
    df = df.withColumn(
        "_path", F.when(tool == "Read", F.nullif(_arg("file_path"), F.lit(""))).when(tool == "Bash", shell_path)
    )
    head = F.regexp_extract("_cmd", r"^(\S*)", 1)
    known = F.coalesce(cwd, F.lit("")) != ""
    kind = F.when(known & F.col("_path").isNotNull() & ~is_sensitive("_path"), "read").when(
        known & (tool == "Bash") & F.col("_path").isNull() & head.isin(*dims.REDUCED_TOOLS), "compress"
    )
    df = df.withColumn("kind", kind)
    done = C.pinned(
        df, kind=F.col("kind"), path=F.when(F.col("kind") == "read", F.col("_path")),
        tool_id=F.when(F.col("kind") == "compress", head),
    )
    return done.select(*calls.columns, "kind", "path", "tool_id")
