"""Column-to-Column helpers: everything stays a JVM expression."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope import dims

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A plain projection may be inlined into a lambda by the optimizer, which would split a
    text again for every element; a lambda variable cannot be.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def pinned(df: DataFrame, **new: Column) -> DataFrame:
    """Add costly columns so that they are worked out once per row.

    A filter on a projected column is pushed below the projection, which copies the column's
    expression, and those it builds on, into the filter. It cannot be pushed below a generator.
    """
    kept = [c for c in df.columns if c not in new]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in new.items()]))))


def estimate_tokens(chars: ColumnLike) -> Column:
    """Four characters per token, halves rounded up, never negative."""
    return F.greatest(F.lit(0).cast("bigint"), F.floor((col(chars) + 2) / 4))


def estimate_text_tokens(text: ColumnLike) -> Column:
    return F.coalesce(estimate_tokens(F.length(col(text))), F.lit(0).cast("bigint"))


def truncate(text: ColumnLike, limit: int = dims.MAX_CONTENT_CHARS) -> Column:
    c = col(text)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def relative_path(root: ColumnLike, file: ColumnLike) -> Column:
    r, f = col(root), col(file)
    tail = F.regexp_replace(F.substr(f, F.length(r) + 1), r"^[/\\]", "")
    return F.when((r != "") & f.startswith(r) & (tail != ""), tail).otherwise(f)


def basename(path: ColumnLike) -> Column:
    return F.regexp_extract(col(path), r"([^/\\]*)$", 1)


def extension(path: ColumnLike) -> Column:
    """Last ``.ext`` of the base name; names that only start with a dot have none."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def language(path: ColumnLike) -> Column:
    """Language of a file by extension; unknown extensions name themselves."""
    ext = extension(path)
    table = F.create_map(*[F.lit(x) for kv in dims.LANG_BY_EXT.items() for x in kv])
    return F.coalesce(
        F.try_element_at(table, ext), F.nullif(F.substr(ext, F.lit(2)), F.lit("")), F.lit("unknown")
    )


def project_id(path: ColumnLike) -> Column:
    return F.substring(F.sha1(col(path)), 1, 16)


def project_name(path: ColumnLike) -> Column:
    last = F.element_at(F.split(col(path), "/", -1), -1)
    return F.when(last == "", col(path)).otherwise(last)


def json_text(meta: ColumnLike, *keys: str) -> Column:
    """First non-empty of the named top-level JSON fields."""
    return F.coalesce(
        *[F.nullif(F.get_json_object(col(meta), f"$.{k}"), F.lit("")) for k in keys]
    )


def lines_of(text: ColumnLike) -> Column:
    return F.split(col(text), "\n", -1)


def line_count(text: ColumnLike) -> Column:
    c = col(text)
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def literal_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(key: ColumnLike, table: dict, default) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, col(key)), F.lit(default))


def run_starts(items: Column, same: Callable[[Column, Column], Column]) -> Column:
    """0-based positions at which a new run of equal neighbours starts."""
    return F.filter(
        F.sequence(F.lit(0), F.size(items) - 1),
        lambda i: (i == 0) | ~same(F.get(items, i), F.get(items, i - 1)),
    )


def runs(items: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Run-length islands as ``array<struct<item, n>>``, in order; linear in the input."""
    return let(
        run_starts(items, same),
        lambda starts: F.transform(
            starts,
            lambda s, k: F.struct(
                F.get(items, s).alias("item"),
                (F.coalesce(F.get(starts, k + 1), F.size(items)) - s).alias("n"),
            ),
        ),
    )
