"""Symbol extraction: corpus -> declarations -> block extents -> chunks.

Each file is one row (files are at most 1 MiB). Per language, one pass of one combined regular
expression marks where declarations start; a second pass reduces the text to its brackets. Both
become events of the file, exploded together.

Block ends come from windows over the events of a file. With a running depth, an opening
bracket and its closing bracket are neighbours within the same depth level, so "the end of this
block" is the next close event in the partition (file, level): linear, no join of declarations
with brackets. Indented languages use the same step with indents as levels.

The corpus is shuffled once, by file. All windows partition by file and more, so they reuse that
partitioning, as does the final join that cuts the bodies out of the text.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions import columns as C
from corpuscope.operators import rules as R

FILE = ["project_id", "file"]
#: Text of a task: events of a file take many times its own size in memory. Fewer bytes than ``LEAST_TEXT`` aren't worth a task.
TASK_TEXT, LEAST_TEXT = 2 << 20, 64 << 10
FLAT = ("css", "scss", "json", "yaml", "toml", "markdown")
BLOCK = tuple(name for name in R.LANGUAGES if name not in FLAT)
# Separators of the marked-up text: before a line, before a rule, before a field.
LINE, RULE, FIELD = "\x01", "\x02", "\x03"
GROUPS = ("name", "name2", "aux", "aux2", "alt", "tail")

EVENT = (
    "struct<line:int,ord:int,kind:string,delta:int,level:int,rule:int,full:string,name:string,"
    "aux:string,alt:string,tail:string,text:string>"
)

# Rule numbers are unique over all languages; lower numbers come first within one.
RULES: list[R.Rule] = []
_FIRST: dict[str, int] = {}
for _lang, _spec in R.LANGUAGES.items():
    _FIRST[_lang] = len(RULES)
    RULES.extend(_spec.rules)


def _markup(lang: str) -> tuple[str, str]:
    """Pattern and replacement that turn a text into one record per line.

    Every rule is an optional lookahead at the start of the line, so a line is visited once
    however many rules there are, and a declaration may run over several lines.
    """
    looks, fields = [], []
    for i, rule in enumerate(R.LANGUAGES[lang].rules):
        pattern = rule.pattern
        present = {g for g in GROUPS if f"(?<{g}>" in pattern}
        for g in GROUPS:
            pattern = pattern.replace(f"(?<{g}>", f"(?<{g}x{i}>")
        looks.append(rf"(?=(?:\h*(?<fullx{i}>{pattern}))?)")

        def ref(*groups: str, i: int = i, present: set = present) -> str:
            return "".join(f"${{{g}x{i}}}" for g in groups if g in present)

        fields.append(
            RULE + FIELD.join(
                (f"${{fullx{i}}}", ref("name", "name2"), ref("aux", "aux2"), ref("alt"), ref("tail"))
            )
        )
    pattern = rf"(?:(?<![\s\S])|\n){''.join(looks)}(?<line>[^\n]*+)"
    return pattern, LINE + "${line}" + "".join(fields)


def _event(**fields: Column) -> Column:
    names = re.findall(r"(\w+):(\w+)", EVENT)
    return F.struct(
        *[fields[n].alias(n) if n in fields else F.lit(None).cast(t).alias(n) for n, t in names]
    )


def _no_events() -> Column:
    return F.array().cast(f"array<{EVENT}>")


def _by_language(langs: tuple[str, ...], value) -> Column:
    """CASE over the languages; those with the same rules share a branch."""
    out, seen = F.when(F.lit(False), value(langs[0])), []
    for lang in langs:
        if R.LANGUAGES[lang] in seen:
            continue
        seen.append(R.LANGUAGES[lang])
        same = [x for x in langs if R.LANGUAGES[x] == R.LANGUAGES[lang]]
        out = out.when(F.col("lang").isin(*same), value(same[0]))
    return out


def line_records(langs: tuple[str, ...]) -> Column:
    """One marked-up record per line of the text, by the rules of the row's language."""
    clean = F.translate("content", LINE + RULE + FIELD, "   ")

    def marked(lang: str) -> Column:
        pattern, replacement = _markup(lang)
        return F.regexp_replace(clean, F.lit(pattern), F.lit(replacement))

    return F.split(F.substr(_by_language(langs, marked), F.lit(2)), LINE, -1)


def declaration_events(langs: tuple[str, ...]) -> Column:
    first = _by_language(langs, lambda x: F.lit(_FIRST[x]))
    first_only = _by_language(langs, lambda x: F.lit(R.LANGUAGES[x].first_only))
    # Lines without a hit end in separators only; they are skipped before any array work.
    bare = _by_language(langs, lambda x: F.lit((RULE + FIELD * 4) * len(R.LANGUAGES[x].rules)))

    def of_line(record: Column, line: Column) -> Column:
        def hits(parts: Column) -> Column:
            found = F.transform(
                F.slice(parts, F.lit(2), F.size(parts) - 1),
                lambda p, k: F.struct(F.split(p, FIELD, -1).alias("f"), k.alias("k")),
            )
            kept = F.filter(found, lambda h: F.get(h.f, F.lit(0)) != "")
            return F.transform(
                F.when(first_only, F.slice(kept, 1, 1)).otherwise(kept),
                lambda h: _event(
                    line=line, ord=F.lit(-1), kind=F.lit("D"), delta=F.lit(0),
                    rule=h.k + first, full=F.get(h.f, F.lit(0)), name=F.get(h.f, F.lit(1)),
                    aux=F.get(h.f, F.lit(2)), alt=F.get(h.f, F.lit(3)), tail=F.get(h.f, F.lit(4)),
                    text=F.get(parts, F.lit(0)),
                ),
            )

        return C.let(F.split(record, RULE, -1), hits)

    return F.flatten(
        F.transform(
            line_records(langs),
            lambda r, i: F.when(r.endswith(bare), _no_events()).otherwise(of_line(r, i)),
        )
    )


def bracket_lines(content: Column, rust: Column | None = None) -> Column:
    """Per line, its brackets outside strings and comments, in order."""
    tokens = F.regexp_extract_all(content, F.lit(R.TOKEN_RES["c"]), F.lit(0))
    if rust is not None:
        tokens = F.when(rust, F.regexp_extract_all(content, F.lit(R.TOKEN_RES["rust"]), F.lit(0))).otherwise(tokens)
    kept = F.transform(
        tokens,
        lambda t: F.when(F.length(t) == 1, t).otherwise(F.regexp_replace(t, r"[^\n]+", "")),
    )
    return F.split(F.array_join(kept, ""), "\n", -1)


def brace_counts(content: C.ColumnLike, rust: Column | None = None) -> Column:
    """Real braces per line: ``array<struct<open, close>>``."""
    return F.transform(
        bracket_lines(C.col(content), rust),
        lambda b: F.struct(
            F.regexp_count(b, F.lit(r"\{")).alias("open"), F.regexp_count(b, F.lit(r"\}")).alias("close")
        ),
    )


def bracket_events() -> Column:
    def of_line(brackets: Column, line: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(brackets, F.lit("."), F.lit(0)),
            lambda b, k: _event(
                line=line, ord=k, kind=F.when(b == "{", "O").otherwise("T"),
                delta=F.when(b.isin("{", "("), 1).otherwise(-1),
            ),
        )

    return F.flatten(
        F.transform(
            bracket_lines(F.col("content"), F.col("lang") == "rust"),
            lambda b, i: F.when(b == "", _no_events()).otherwise(of_line(b, i)),
        )
    )


def keyword_events(lines: Column) -> Column:
    def of_line(line: Column, i: Column) -> Column:
        return F.when(
            line.rlike(R.KEYWORD_OPEN_RE),
            _event(line=i, ord=F.lit(0), kind=F.lit("O"), delta=F.lit(1)),
        ).when(
            line.rlike(R.KEYWORD_CLOSE_RE),
            _event(line=i, ord=F.lit(0), kind=F.lit("T"), delta=F.lit(-1)),
        )

    return F.filter(F.transform(lines, of_line), lambda e: e.isNotNull())


def statement_events(lines: Column) -> Column:
    """Lines that end a statement or open a block, at the start of the line."""
    return F.filter(
        F.transform(
            lines,
            lambda line, i: _event(
                line=i, ord=F.lit(-2), kind=F.lit("S"), delta=F.lit(0),
                text=F.regexp_extract(line, R.STATEMENT_END_RE, 1),
            ),
        ),
        lambda e: e.text != "",
    )


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))


def indent_events(lines: Column, declared: Column, kind: str, comments: bool) -> Column:
    """Lines that close deeper or equal indents, one event per declared indent they close.

    A block of indent b ends at the first later line with indent <= b; the line before that one
    is deeper than b or is the declaration itself. So a line closes just the declared levels
    between its own indent and the indent of the line before it.
    """
    plain = F.transform(
        lines, lambda line, i: F.struct(i.alias("i"), _indent(line).alias("d"), F.trim(line).alias("t"))
    )
    solid = F.filter(
        plain, lambda x: x.t.rlike(r"\S") if comments else (x.t.rlike(r"\S") & ~x.t.startswith("#"))
    )

    def closers(rows: Column) -> Column:
        def of_line(x: Column, k: Column) -> Column:
            before = F.coalesce(F.get(rows, k - 1).d, F.lit(-1))
            return F.when(x.d > before, _no_events()).otherwise(
                F.transform(
                    F.filter(declared, lambda b: (b >= x.d) & (b <= before)),
                    lambda b: _event(line=x.i, ord=F.lit(-3), kind=F.lit(kind), delta=F.lit(0), level=b),
                )
            )

        return F.flatten(F.transform(rows, of_line))

    return C.let(solid, closers)


def _langs_with(test) -> list[str]:
    return [x for x in BLOCK if test(R.LANGUAGES[x])]


@lru_cache(maxsize=1)
def _file_events(application: str) -> Column:
    indented = _langs_with(lambda x: any(r.extent == "indent" for r in x.rules))
    keyword = _langs_with(lambda x: x.keyword_ends)
    statements = _langs_with(lambda x: any(r.extent in ("arrow", "alias") for r in x.rules))
    lang = F.col("lang")

    def with_indents(d: Column) -> Column:
        leveled = F.transform(d, lambda e: e.withField("level", _indent(e.text)))
        return C.let(
            C.lines_of("content"),
            lambda lines: C.let(
                F.array_distinct(F.transform(d, lambda e: _indent(e.text))),
                lambda declared: F.concat(
                    leveled,
                    indent_events(lines, declared, "C", comments=True),
                    indent_events(lines, declared, "B", comments=False),
                ),
            ),
        )

    def complete(d: Column) -> Column:
        return (
            F.when(lang.isin(*indented), with_indents(d))
            .when(lang.isin(*keyword), F.concat(d, C.let(C.lines_of("content"), keyword_events)))
            .when(
                lang.isin(*statements),
                F.concat(d, bracket_events(), C.let(C.lines_of("content"), statement_events)),
            )
            .otherwise(F.concat(d, bracket_events()))
        )

    # A file without declarations needs no brackets.
    return C.let(
        declaration_events(BLOCK), lambda d: F.when(F.size(d) == 0, _no_events()).otherwise(complete(d))
    )


@lru_cache(maxsize=1)
def _flat_events(application: str) -> Column:
    return declaration_events(FLAT)


def file_events(table: DataFrame) -> Column:
    """All events of a file of a block language, from ``lang`` and ``content``.

    The expression does not depend on the table, so it is built once per application.
    """
    return _file_events(table.sparkSession.sparkContext.applicationId)


def _rule_numbers(test) -> list[int]:
    return [i for i, r in enumerate(RULES) if test(r)]


def _extent_is(*extents: str) -> Column:
    return F.col("rule").isin(_rule_numbers(lambda r: r.extent in extents))


def _pick_rule(field) -> Column:
    """Per-rule constant of the current row."""
    values = ", ".join(f"'{field(r)}'" for r in RULES)  # no value holds a quote
    return F.expr(f"element_at(array({values}), rule + 1)")


def with_extents(events: DataFrame) -> DataFrame:
    """Declarations with ``end`` and ``scope_end`` (0-based lines) from the events of their files.

    Expects the event columns, ``project_id``, ``file`` and ``n_lines``.
    """
    pos = F.col("line").cast("bigint") * 2**32 + F.col("ord")  # both are below 2^31
    df = events.withColumn("pos", pos)
    forward = Window.partitionBy(*FILE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(*FILE).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("depth", F.sum("delta").over(forward))
    opening = F.when(
        F.col("kind") == "O", F.struct("pos", (F.col("depth") - F.col("delta")).alias("before"))
    )
    df = df.withColumn("next_open", F.last(opening, ignorenulls=True).over(backward))
    stop = F.struct("line", "text", "depth", "next_open")
    df = df.withColumn(
        "next_stop", F.last(F.when(F.col("kind") == "S", stop), ignorenulls=True).over(backward)
    ).withColumn(
        "next_semi",
        F.last(F.when((F.col("kind") == "S") & (F.col("text") == ";"), F.col("line")), ignorenulls=True).over(backward),
    )
    # A stop on the declaration's own line sorts just before it; look there first.
    own_end = F.regexp_extract("text", R.STATEMENT_END_RE, 1)
    df = df.withColumn(
        "own_stop",
        F.last(F.when(F.col("kind") == "S", stop), ignorenulls=True).over(forward),
    )
    own_open = F.when(F.col("own_stop.line") == F.col("line"), F.col("own_stop.next_open"))
    last_line = F.col("n_lines") - 1
    one_line = F.col("text").rlike(R.ARROW_ONE_LINE_RE)
    no_block = (
        _extent_is("body") & ~F.col("text").contains("{")
    ) | (
        F.col("rule").isin(_rule_numbers(lambda r: r.scope and r.extent == "brace"))
        & F.col("text").rlike(r";\s*$") & ~F.col("text").contains("{")
    )
    known = (
        F.when(_extent_is("line") | no_block, F.col("line"))
        .when(_extent_is("arrow") & one_line, F.col("line"))
        .when(_extent_is("arrow", "alias") & (own_end == ";"), F.col("line"))
        .when(_extent_is("arrow") & (own_end == "") & (F.col("next_stop.text") == ";"), F.col("next_stop.line"))
        .when(_extent_is("arrow") & (own_end == "") & F.col("next_stop").isNull(), last_line)
        .when(_extent_is("alias") & (own_end == ""), F.coalesce("next_semi", last_line))
    )
    from_stop = _extent_is("arrow") & (own_end == "")
    start = F.when(from_stop, F.col("next_stop.next_open")).when(
        _extent_is("arrow", "alias"), F.coalesce(own_open, F.col("next_open"))
    ).otherwise(F.col("next_open"))
    base = F.when(from_stop, F.col("next_stop.depth")).otherwise(F.col("depth"))
    by_indent = _extent_is("indent")
    is_decl = F.col("kind") == "D"
    df = (
        df.withColumn("known_end", F.when(is_decl, known))
        .withColumn("_start", start)
        .withColumn(
            "_level",
            F.when(is_decl, F.when(by_indent, F.col("level")).otherwise(F.least(base, F.col("_start.before"))))
            .when(F.col("kind").isin("C", "B"), F.col("level"))
            .otherwise(F.col("depth")),
        )
        .withColumn("_at", F.when(is_decl & ~by_indent, F.col("_start.pos")).otherwise(F.col("pos")))
        .filter(is_decl | F.col("kind").isin("C", "B") | (F.col("delta") == -1))
        .drop("next_open", "next_stop", "next_semi", "own_stop", "_start", "depth", "level", "pos")
    )
    level = (
        Window.partitionBy(*FILE, "_level").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    )

    def next_line(test: Column) -> Column:
        return F.last(F.when(test, F.col("line")), ignorenulls=True).over(level)

    df = (
        df.withColumn("_close", next_line(F.col("kind") == "T"))
        .withColumn("_dedent", next_line(F.col("kind") == "C"))
        .withColumn("_leave", next_line(F.col("kind") == "B"))
    )
    by_block = F.when(by_indent, F.coalesce(F.col("_dedent") - 1, last_line)).otherwise(
        F.when(F.col("_at").isNotNull(), F.coalesce("_close", last_line)).otherwise(last_line)
    )
    return (
        df.filter(is_decl)
        .withColumn("end", F.coalesce("known_end", by_block).cast("int"))
        .withColumn(
            "scope_end",
            F.when(by_indent, F.coalesce(F.col("_leave") - 1, last_line)).otherwise(F.col("end")).cast("int"),
        )
        .select(*FILE, "lang", "n_lines", "line", "end", "scope_end", "rule", "full", "name", "aux", "alt", "tail", "text")
    )


def with_scope(decls: DataFrame) -> DataFrame:
    """Adds ``scope``: the innermost enclosing scope's name, for members only.

    Scopes nest, so with a running nesting depth the enclosing scope of a member is the last one
    opened at the member's depth.
    """
    scoping = F.col("rule").isin(_rule_numbers(lambda r: r.scope))
    name = F.when(F.col("alt") != "", F.col("alt")).otherwise(F.col("name"))
    point = lambda line, order, step: F.struct(
        line.alias("p_line"), F.lit(order).alias("p_order"), F.lit(step).alias("p_step")
    )
    points = F.when(
        scoping, F.array(point(F.col("line"), 0, 1), point(F.col("scope_end"), 9, -1))
    ).otherwise(F.array(point(F.col("line"), 1, 0)))
    df = decls.select("*", F.explode(points).alias("_p")).select("*", "_p.*").drop("_p")
    order = [F.col("p_line"), F.col("p_order"), F.col("rule")]
    forward = Window.partitionBy(*FILE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_nest", F.sum("p_step").over(forward))
    level = Window.partitionBy(*FILE, "_nest").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("scope", F.last(F.when(F.col("p_step") == 1, name), ignorenulls=True).over(level))
    member = F.col("rule").isin(_rule_numbers(lambda r: r.member))
    return (
        df.filter(F.col("p_step") >= 0)
        .withColumn("scope", F.when(member & (F.col("_nest") > 0), F.col("scope")))
        .drop("p_line", "p_order", "p_step", "_nest")
    )


def _fill(template: Column, **values: Column) -> Column:
    return reduce(
        lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), template
    )


def _named(decls: DataFrame) -> DataFrame:
    """Name, type, content and id of every declaration."""
    own = F.when(F.coalesce("alt", F.lit("")) != "", F.col("alt")).otherwise(F.col("name"))
    own = F.when(own == "", F.lit("file")).otherwise(own)
    full_name = F.when(F.col("scope").isNotNull(), F.concat("scope", F.lit("."), own)).otherwise(own)
    df = decls.withColumn("name", full_name).withColumn("type", _pick_rule(lambda r: r.type))
    bracketed = F.when(F.col("aux") != "", F.concat(F.lit("("), "aux", F.lit(")"))).otherwise("")
    # Free text goes in last, so that braces in it are left alone.
    content = _fill(
        _pick_rule(lambda r: r.content),
        method=F.when(F.col("scope").isNotNull(), F.lit("method ")).otherwise(""),
        name=F.col("name"), **{"aux?": bracketed}, aux=F.col("aux"), tail=F.col("tail"),
        line=F.regexp_replace(F.col("text"), r"^\s+|\s+$", ""),
        full=F.regexp_replace(F.col("full"), r"^\s+|\s+$", ""),
    )
    return df.withColumn("content", content).withColumn(
        "id", F.concat_ws(":", "file", _pick_rule(lambda r: r.code), "name")
    )


IMPL_RULE = [i for i, r in enumerate(RULES) if r.content == "impl {name}"]


def text_size(corpus: DataFrame) -> int:
    """Bytes of the texts of a corpus; one pass over them."""
    return int(corpus.agg(F.sum(F.octet_length("content").cast("bigint"))).first()[0] or 0)


def file_partitions(corpus: DataFrame, size: int | None = None) -> int | None:
    """Tasks that the texts of a corpus are dealt to, by their ``size``. Adaptive execution would go by the compressed size
    and the number of cores, so that a task's events grow with the corpus."""
    if corpus.isStreaming:
        return None
    size = text_size(corpus) if size is None else size
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    return max(1, min(cores, size // LEAST_TEXT), size // TASK_TEXT)


def block_chunks(corpus: DataFrame, partitions: int | None = None) -> DataFrame:
    """Chunks of the languages whose declarations span blocks."""
    langs = corpus.filter(F.col("lang").isin(*BLOCK)).select(*FILE, "lang", "content")
    # A constant project would drop out of the windows' keys, and all events would be shuffled again to meet these.
    langs = langs.withColumn("project_id", F.concat("project_id", F.left("file", F.lit(0))))
    by_file = langs.repartition(partitions, *FILE) if partitions else langs.repartition(*FILE)
    # Beside a generator a column is worked out for every row that it gives, from the whole text each time.
    whole = C.pinned(by_file, n_lines=C.line_count("content"), events=file_events(corpus))
    rows = whole.select(*FILE, "lang", "n_lines", F.explode("events").alias("e")).select(*FILE, "lang", "n_lines", "e.*")
    decls = _named(with_scope(with_extents(rows)))
    # Rust: an impl without a name declares nothing; a bodiless type is its own line.
    decls = decls.filter(~(F.col("rule").isin(IMPL_RULE) & (F.col("name") == "file")))
    sliced = ~_extent_is("line")
    item = F.struct(
        "id", "name", "type", "line", "end", "content", "rule", sliced.alias("sliced")
    )
    per_file = decls.groupBy(*FILE).agg(F.collect_list(item).alias("_decls"))
    joined = by_file.join(per_file.hint("merge"), FILE)  # both are dealt by file; neither is bounded

    def bodies(lines: Column) -> Column:
        return F.transform(
            "_decls",
            lambda d: d.withField(
                "body",
                F.when(
                    d.sliced,
                    F.array_join(F.slice(lines, d.line + 1, F.greatest(d.end - d.line + 1, F.lit(1))), "\n"),
                ).otherwise(d.content),
            ),
        )

    out = joined.select(*FILE, "lang", F.explode(C.let(C.lines_of("content"), bodies)).alias("d"))
    return out.select(
        "project_id", "d.id", "file", "d.name", "d.type",
        (F.col("d.line") + 1).alias("line"),
        (F.greatest("d.line", "d.end") + 1).alias("line_end"),
        "d.content", "d.body", "lang", F.col("d.rule").alias("seq"),
    )


def flat_chunks(corpus: DataFrame) -> DataFrame:
    """Chunks of the line-oriented formats: no blocks, hence no shuffle."""
    langs = corpus.filter(F.col("lang").isin(*FLAT))
    events = _flat_events(corpus.sparkSession.sparkContext.applicationId)
    rows = langs.select(*FILE, "lang", F.explode(events).alias("e")).select(*FILE, "lang", "e.*")
    named = _named(rows.withColumn("scope", F.lit(None).cast("string")))
    return named.select(
        "project_id", "id", "file", "name", "type", (F.col("line") + 1).alias("line"),
        (F.col("line") + 1).alias("line_end"), "content", F.col("content").alias("body"), "lang",
        F.col("rule").alias("seq"),
    )


def inline_chunks(corpus: DataFrame) -> DataFrame:
    """Chunks of formats in which a pattern may match many times per line: no shuffle.

    A marker put before every match keeps the line structure, so the k-th marker's line belongs
    to the k-th match.
    """
    langs = corpus.filter(F.col("lang").isin(*R.INLINE))
    found = F.array().cast("array<struct<line:int,seq:int,name:string,full:string>>")
    for lang, inline in R.INLINE.items():
        per_rule = []
        for seq, rule in enumerate(inline):
            flags = "(?i)" if rule.pattern.startswith("(?i)") else ""
            pattern = rule.pattern.removeprefix("(?i)")
            clean = F.translate("content", LINE, " ")
            # Group 1 is the lead, group 2 the reported part, the name one further in.
            expr = f"{flags}({rule.lead})({pattern})"
            marked = F.regexp_replace(clean, F.lit(expr), F.lit(f"$1{LINE}$2"))
            lines = F.flatten(
                F.transform(
                    F.split(marked, "\n", -1),
                    lambda t, i: F.array_repeat(
                        i + 1, F.length(t) - F.length(F.replace(t, F.lit(LINE), F.lit("")))
                    ),
                )
            )
            matches = F.arrays_zip(
                lines.alias("line"),
                F.regexp_extract_all(clean, F.lit(expr), F.lit(2 + rule.group)).alias("name"),
                F.regexp_extract_all(clean, F.lit(expr), F.lit(2)).alias("full"),
            )
            per_rule.append(
                F.transform(
                    matches,
                    lambda m, seq=seq: F.struct(
                        m["line"].cast("int").alias("line"), F.lit(seq).alias("seq"),
                        m["name"].alias("name"), F.trim(m["full"]).alias("full"),
                    ),
                )
            )
        found = F.when(F.col("lang") == lang, F.concat(*per_rule)).otherwise(found)
    rows = langs.select(*FILE, "lang", F.explode(found).alias("m")).select(*FILE, "lang", "m.*")
    kind = F.create_map(*[F.lit(x) for k, v in R.INLINE.items() for x in (k, v[0].type)])
    code = F.create_map(*[F.lit(x) for k, v in R.INLINE.items() for x in (k, v[0].code)])
    text = F.regexp_replace("full", r"^\s+|\s+$", "")
    return rows.select(
        "project_id", F.concat_ws(":", "file", F.element_at(code, F.col("lang")), "name").alias("id"), "file",
        "name", F.element_at(kind, F.col("lang")).alias("type"), "line", F.col("line").alias("line_end"),
        text.alias("content"), text.alias("body"), "lang", "seq",
    )


def extract_chunks(corpus: DataFrame, partitions: int | None = None) -> DataFrame:
    """All chunks of a corpus(project_id, file, content); unknown extensions give none.

    ``seq`` orders chunks that share a place, as the rules are ordered.
    """
    df = corpus if "lang" in corpus.columns else corpus.withColumn("lang", C.language("file"))
    partitions = partitions or file_partitions(corpus)
    return (
        block_chunks(df, partitions).unionByName(flat_chunks(df)).unionByName(inline_chunks(df))
    )


def dedupe_chunks(chunks: DataFrame, partitions: int | None = None) -> DataFrame:
    """One chunk per (file, name, type, line), the first rule's, with the stored content cut. ``partitions``: tasks that the files are dealt to."""
    key = ["project_id", "file", "name", "type", "line"]
    first = Window.partitionBy(*key).orderBy("seq")
    if partitions:
        chunks = chunks.withColumn("project_id", F.concat("project_id", F.left("file", F.lit(0)))).repartition(partitions, *FILE)
    return (
        chunks.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1).drop("_rn", "seq")
        .withColumn("content", C.truncate("content"))
    )


def corpus_chunks(corpus: DataFrame, size: int | None = None) -> DataFrame:
    """The chunks of a corpus as they are stored: one for each (file, name, type, line). ``size``: bytes of its texts, if known."""
    partitions = file_partitions(corpus, size)
    return dedupe_chunks(extract_chunks(corpus, partitions), partitions)
