"""Reference edges between symbols, and one-hop lookups.

Edges are kept factored: a table of references by name, the definitions of names, and unresolved imports. Its size is
linear in the corpus however often a name is used. Pairs of a reference and a definition are made for the
symbols or files that are asked for, or by ``symbol_edges`` where all of them are wanted; counts come from aggregates.

An edge row carries ``n``, how often the reference occurs (source occurrences x matching target
chunks), so repeats cost no rows: edge counts are sums of ``n``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope import dims
from corpuscope.functions import columns as C
from corpuscope.operators.ranking import top_k_per_group
from corpuscope.session import cut_lineage

# How references look.
CALL_RE = r"[^\w.](\w+)\s*\("
IMPORT_FROM_RE = r"import\s+(?:(?:\*\s+as\s+)?\w+\s+from\s+|[\w\s{},*]+from\s+)['\"](\.[^'\"]+)['\"]"
IMPORT_NAME_RE = r"import\s+(?:\*\s+as\s+)?(\w+)"
REQUIRE_RE = r"(?:const|let|var)\s+(\w+)\s*=\s*require\s*\(\s*['\"](\.[^'\"]+)['\"]\s*\)"
EXTENDS_RE = r"(?:^|\n)\s*(?:export\s+)?(?:abstract\s+)?class\s+\w+\s+extends\s+(\w+)"
IMPLEMENTS_RE = r"(?:^|\n)\s*(?:export\s+)?(?:abstract\s+)?class\s+\w+(?:\s+extends\s+\w+)?\s+implements\s+([\w,\s]+)"

#: Files of a block, whose references to a name are bits of a few longs.
BLOCK_FILES = 512
MASKS = [f"m{i}" for i in range(BLOCK_FILES // 64)]
#: Definitions times blocks that are counted at once: what a wave shuffles doesn't grow with the corpus.
WAVE_ROWS = 1 << 26
#: The names of a project that most files refer to, whose overlaps are known exactly.
HOT_NAMES = 10

EDGE_KEY = ["project_id", "source_file", "source_symbol", "target_file", "target_symbol", "kind"]


def definitions(chunks: DataFrame) -> DataFrame:
    """Files that define a name, with the number of defining chunks."""
    return (
        chunks.filter(F.col("type").isin(*dims.SYMBOL_TYPES))
        .groupBy("project_id", "name", F.col("file").alias("target_file"))
        .agg(F.count(F.lit(1)).alias("n_defs"))
    )


def references(chunks: DataFrame) -> DataFrame:
    """Calls, extensions and implementations by name, counted per source symbol."""
    body = F.when(F.coalesce("body", F.lit("")) != "", F.col("body")).otherwise(F.col("content"))
    calls = F.transform(
        F.filter(
            F.regexp_extract_all(body, F.lit(CALL_RE), F.lit(1)), lambda n: ~n.isin(*dims.CALL_KEYWORDS)
        ),
        lambda n: F.struct(F.lit("call").alias("kind"), n.alias("name")),
    )
    base = F.regexp_extract(body, EXTENDS_RE, 1)
    extends = F.when(base != "", F.array(F.struct(F.lit("extend").alias("kind"), base.alias("name")))).otherwise(
        F.array().cast("array<struct<kind:string,name:string>>")
    )
    listed = F.regexp_extract(body, IMPLEMENTS_RE, 1)
    implements = F.transform(
        F.filter(F.transform(F.split(listed, ","), lambda s: F.regexp_replace(s, r"\s", "")), lambda s: s != ""),
        lambda s: F.struct(F.lit("implement").alias("kind"), s.alias("name")),
    )
    found = F.concat(calls, F.when(F.contains(body, F.lit("class")), F.concat(extends, implements)).otherwise(
        F.array().cast("array<struct<kind:string,name:string>>")
    ))
    return (
        chunks.filter(~F.col("type").isin(*dims.NON_CALLING_TYPES))
        .select("project_id", F.col("file").alias("source_file"), F.col("name").alias("source_symbol"), F.explode(found).alias("r"))
        .groupBy("project_id", "source_file", "source_symbol", "r.kind", "r.name")
        .agg(F.count(F.lit(1)).alias("n_refs"))
    )


def symbol_edges(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """References meet definitions of the same name in other files of the project.

    Both sides are combined per file and name before; a hot name is split by the adaptive skew join.
    """
    return (
        refs.join(defs, ["project_id", "name"]).filter(F.col("source_file") != F.col("target_file"))
        .select(
            "project_id", "source_file", "source_symbol", "target_file", F.col("name").alias("target_symbol"),
            "kind", (F.col("n_refs") * F.col("n_defs")).alias("n"),
        )
    )


def normalize_path(path: C.ColumnLike) -> Column:
    """Resolve ``.`` and ``..`` parts; the number of parts of one path is small."""

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        up = (x == "..") & (F.size(acc) > 0) & (last != "..")
        return F.when(up, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))

    def resolve(p: Column) -> Column:
        parts = F.filter(F.split(p, "/", -1), lambda x: (x != "") & (x != "."))
        absolute = p.startswith("/")
        return C.let(
            F.aggregate(parts, F.array().cast("array<string>"), step),
            lambda done: F.when(
                absolute, F.concat(F.lit("/"), F.array_join(F.filter(done, lambda x: x != ".."), "/"))
            ).otherwise(F.array_join(done, "/")),
        )

    return C.let(C.col(path), resolve)


def _directory(path: C.ColumnLike) -> Column:
    return F.regexp_replace(C.col(path), r"/?[^/]*$", "")


def stems(listing: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """(project_id, stem, file): what names each file of listing(project_id, file) once a suffix is put after them; of several files of one
    stem that of the first suffix. A file ends in few of the suffixes, so it gives few rows."""
    file = F.col("file")
    cut = [F.struct(F.when(file.endswith(s), F.left(file, F.length(file) - len(s))).alias("stem"), F.lit(i).alias("pos")) for i, s in enumerate(suffixes)]
    each = listing.select("project_id", "file", F.explode(F.filter(F.array(*cut), lambda x: x["stem"].isNotNull())).alias("s"))
    return each.groupBy("project_id", F.col("s.stem").alias("stem")).agg(F.min_by("file", "s.pos").alias("file"))


def probe(requests: DataFrame, base: str, listing: DataFrame, suffixes: tuple[str, ...], out: str) -> DataFrame:
    """First existing ``base + suffix`` per request, in suffix order (null if none exists): one equi-join with the stems of the listing."""
    known = stems(listing, suffixes).select("project_id", F.col("stem").alias(base), F.col("file").alias(out))
    return requests.join(known, ["project_id", base], "left").select(*requests.columns, out)


def import_references(chunks: DataFrame) -> DataFrame:
    """Relative imports and requires with the path they name, not yet resolved, counted per source symbol."""
    content = F.col("content")
    imports = chunks.filter(F.col("type") == "import").select(
        "project_id", F.col("file").alias("source_file"),
        F.regexp_extract(content, IMPORT_FROM_RE, 1).alias("_from"),
        F.regexp_extract(content, IMPORT_NAME_RE, 1).alias("_name"),
        F.regexp_extract(content, REQUIRE_RE, 1).alias("_req_name"),
        F.regexp_extract(content, REQUIRE_RE, 2).alias("_req"),
    )
    path = F.when(F.col("_from") != "", F.col("_from")).otherwise(F.col("_req"))
    name = F.when(F.col("_from") == "", F.col("_req_name")).when(F.col("_name") != "", F.col("_name")).otherwise(
        F.element_at(F.split(path, "/"), -1)
    )
    return imports.filter(path != "").select(
        "project_id", "source_file", name.alias("source_symbol"),
        normalize_path(F.concat(_directory("source_file"), F.lit("/"), path)).alias("path"),
    ).groupBy("project_id", "source_file", "source_symbol", "path").agg(F.count(F.lit(1)).alias("n"))


def resolve_imports(imports: DataFrame, listing: DataFrame) -> DataFrame:
    """Edges of unresolved imports, against the listing of files."""
    named = C.extension("path") != ""
    given = imports.filter(named).withColumn("target_file", F.col("path"))
    probed = probe(imports.filter(~named), "path", listing, dims.IMPORT_SUFFIXES, "target_file").withColumn(
        "target_file", F.coalesce("target_file", F.concat("path", F.lit(".ts")))
    )
    return given.unionByName(probed).select(
        "project_id", "source_file", "source_symbol", "target_file", F.col("source_symbol").alias("target_symbol"),
        F.lit("import").alias("kind"), "n",
    )


def _bit(slot: str, mask: int) -> Column:
    """The bit of a file's place in its block, in the long number ``mask``."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col(slot), F.lit(64)).cast("int"))
    return F.when(F.floor(F.col(slot) / 64) == mask, one).otherwise(F.lit(0).cast("bigint"))


@dataclass(frozen=True)
class EdgeTables:
    """All edges of an index, factored: what each file refers to, what each file defines, and the files there are."""

    references: DataFrame
    definitions: DataFrame
    imports: DataFrame
    listing: DataFrame

    @classmethod
    def of(cls, chunks: DataFrame, listing: DataFrame) -> EdgeTables:
        return cls(references(chunks), definitions(chunks), import_references(chunks), listing)

    def stored(self) -> EdgeTables:
        """The same tables, written: for work that reads them often, as bodies are searched for references each time otherwise."""
        return EdgeTables(cut_lineage(self.references), cut_lineage(self.definitions), cut_lineage(self.imports), self.listing)

    def expand(self) -> DataFrame:
        """Every edge as a row."""
        return symbol_edges(self.references, self.definitions).unionByName(resolve_imports(self.imports, self.listing))

    def counts(self) -> DataFrame:
        """(project_id, n): edges per project, from aggregates by name; no pair is made.

        All references of a name times all its definitions, less those of the same file.
        """
        name = ["project_id", "name"]
        refs = self.references.groupBy(*name, F.col("source_file").alias("file")).agg(F.sum("n_refs").alias("r"))
        defs = self.definitions.select(*name, F.col("target_file").alias("file"), F.col("n_defs").alias("d"))
        every = refs.groupBy(*name).agg(F.sum("r").alias("r")).join(defs.groupBy(*name).agg(F.sum("d").alias("d")), name)
        own = refs.join(defs, [*name, "file"])
        parts = (
            every.select("project_id", (F.col("r") * F.col("d")).alias("n"))
            .unionByName(own.select("project_id", (-F.col("r") * F.col("d")).alias("n")))
            .unionByName(self.imports.select("project_id", "n"))
        )
        return parts.groupBy("project_id").agg(F.sum("n").alias("n")).filter("n > 0")

    def related(self, symbols: DataFrame, keys: list[str]) -> DataFrame:
        """Out- and in-edges of symbols(*keys, project_id, file, name); only their references and definitions are paired."""
        s = symbols.select(*keys, "project_id", "file", "name")
        source = s.withColumnsRenamed({"file": "source_file", "name": "source_symbol"})
        asked = self.references.join(source, ["project_id", "source_file", "source_symbol"])
        out = asked.join(self.definitions, ["project_id", "name"]).filter(F.col("source_file") != F.col("target_file")).select(
            *keys, F.col("target_file").alias("file"), F.col("name").alias("symbol"), "kind", F.lit("out").alias("direction"),
            (F.col("n_refs") * F.col("n_defs")).alias("n"))
        target = s.withColumnRenamed("file", "target_file")
        into = self.definitions.join(target, ["project_id", "name", "target_file"]).join(self.references, ["project_id", "name"]).filter(
            F.col("source_file") != F.col("target_file")).select(
            *keys, F.col("source_file").alias("file"), F.col("source_symbol").alias("symbol"), "kind", F.lit("in").alias("direction"),
            (F.col("n_refs") * F.col("n_defs")).alias("n"))
        names = s.select("project_id", F.col("name").alias("source_symbol")).distinct()
        near = resolve_imports(self.imports.join(names, ["project_id", "source_symbol"], "left_semi"), self.listing)
        return out.unionByName(into).unionByName(related(near, symbols, keys))

    def impacted(self, files: DataFrame) -> DataFrame:
        """Dependents of the given files(project_id, file); only their definitions are paired with references, and only imports of a path
        that can mean one of them are resolved: the path itself, or that without a suffix."""
        asked = files.select("project_id", F.col("file").alias("target_file")).distinct()
        named = symbol_edges(self.references, self.definitions.join(asked, ["project_id", "target_file"], "left_semi"))
        file = F.col("target_file")
        cut = F.array(file, *[F.when(file.endswith(s), F.left(file, F.length(file) - len(s))) for s in dims.IMPORT_SUFFIXES])
        meant = asked.select("project_id", F.explode(F.array_compact(cut)).alias("path")).distinct()
        near = self.imports.join(meant, ["project_id", "path"], "left_semi")
        return impacted(named.unionByName(resolve_imports(near, self.listing)), files)


    @cached_property
    def _sources(self) -> DataFrame:
        """(project_id, source_file, block, slot): the files that refer to others, in blocks of at most ``BLOCK_FILES`` drawn by a hash."""
        each = self.references.select("project_id", "source_file").unionByName(self.imports.select("project_id", "source_file")).distinct()
        most = each.groupBy("project_id").agg(F.ceil(F.count(F.lit(1)) / (BLOCK_FILES * 7 / 8)).alias("_blocks"))
        drawn = F.floor(F.pmod(F.xxhash64("source_file"), F.lit(1 << 31)) * F.col("_blocks") / (1 << 31))
        place = F.row_number().over(Window.partitionBy("project_id", "_drawn").orderBy("source_file")) - 1
        placed = each.join(most, "project_id").withColumn("_drawn", drawn).withColumn("_place", place)
        return cut_lineage(placed.select(
            "project_id", "source_file", (F.col("_drawn") + F.col("_blocks") * F.floor(F.col("_place") / BLOCK_FILES)).alias("block"),
            (F.col("_place") % BLOCK_FILES).alias("slot")))

    @cached_property
    def _users(self) -> DataFrame:
        """(project_id, name, block, m0, m1, ...): the files of a block that refer to a name, one bit each."""
        each = self.references.select("project_id", "name", "source_file").distinct().join(self._sources, ["project_id", "source_file"])
        return cut_lineage(each.groupBy("project_id", "name", "block").agg(*[F.bit_or(_bit("slot", i)).alias(m) for i, m in enumerate(MASKS)]))

    def _block_referrers(self, files: DataFrame, imported: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
        """(project_id, target_file, n): how many files of the blocks from ``low`` to below ``high`` refer to each of files(project_id, target_file).

        A definition meets each block once, not each file of it."""
        target = ["project_id", "target_file"]
        among = (F.col("block") >= low) if high is None else (F.col("block") >= low) & (F.col("block") < high)
        own = self._sources.select("project_id", F.col("source_file").alias("target_file"), F.col("block").alias("_block"), F.col("slot").alias("_slot"))
        defined = self.definitions.select(*target, "name").join(files.select(*target), target, "left_semi").join(own, target, "left")
        itself = F.coalesce(F.col("block") == F.col("_block"), F.lit(False))
        named = defined.join(self._users.filter(among), ["project_id", "name"]).select(*target, "block", *[
            F.when(itself, F.col(m).bitwiseAND(F.bitwise_not(_bit("_slot", i)))).otherwise(F.col(m)).alias(m) for i, m in enumerate(MASKS)])
        brought = imported.join(files.select(*target), target, "left_semi").join(self._sources.filter(among), ["project_id", "source_file"]).select(
            *target, "block", *[_bit("slot", i).alias(m) for i, m in enumerate(MASKS)])
        each = named.unionByName(brought).groupBy(*target, "block").agg(*[F.bit_or(m).alias(m) for m in MASKS])
        counts = each.groupBy(*target).agg(F.sum(sum(F.bit_count(m) for m in MASKS)).cast("bigint").alias("n"))
        return counts.filter("n > 0")

    def _referrers(self, files: DataFrame, imported: DataFrame) -> DataFrame:
        """(project_id, target_file, n): how many files refer to each of files(project_id, target_file)."""
        return self._block_referrers(files, imported)

    def fan_in_bounds(self) -> tuple[DataFrame, DataFrame]:
        """(project_id, target_file, bound): no more files refer to it, as those that refer to each of its names, and those that import
        it, may overlap; and the distinct (project_id, target_file, source_file) of imports. No reference is paired with a definition."""
        target = ["project_id", "target_file"]
        imported = resolve_imports(self.imports, self.listing).select(*target, "source_file").distinct()
        users = self.references.select("project_id", "name", "source_file").distinct().groupBy("project_id", "name").agg(F.count(F.lit(1)).alias("b"))
        parts = self.definitions.select(*target, "name").distinct().join(users, ["project_id", "name"]).select(*target, "b")
        parts = parts.unionByName(imported.groupBy(*target).agg(F.count(F.lit(1)).alias("b")))
        return parts.groupBy(*target).agg(F.sum("b").alias("bound")), imported

    def fan_in(self, k: int = 10, wave: int = 4) -> DataFrame:
        """Files referenced from the most other files, the first ``k``; exact.

        The ``wave * k`` files with the highest bounds are counted first. Of the others only those are, whose bound reaches the k-th count.
        Where names are so common that many bounds do, these are tightened, and files that still may win are counted in waves of blocks.
        """
        bounds, imported = self.fan_in_bounds()
        bounds, imported = cut_lineage(bounds), cut_lineage(imported)
        order = [F.desc("bound"), F.asc("project_id"), F.asc("target_file")]
        first = cut_lineage(bounds.orderBy(*order).limit(wave * k))
        counted = cut_lineage(self._referrers(first.drop("bound"), imported))
        best = sorted((-r.n, r.project_id, r.target_file) for r in counted.collect())[:k]  # at most wave * k rows
        may_win = F.lit(True)
        if len(best) == k:
            n, project, file = best[-1]
            before = (F.col("project_id") < project) | ((F.col("project_id") == project) & (F.col("target_file") < file))
            may_win = (F.col("bound") > -n) | ((F.col("bound") == -n) & before)
        rest = cut_lineage(bounds.filter(may_win).join(first, ["project_id", "target_file"], "left_anti"))
        if len(best) == k and rest.count() > wave * k:
            rest = cut_lineage(self._tightened(rest, imported).filter(may_win))
        return counted.unionByName(self._counted(rest, imported, may_win)).orderBy(F.desc("n"), "project_id", "target_file").limit(k)

    def _tightened(self, rest: DataFrame, imported: DataFrame) -> DataFrame:
        """rest(project_id, target_file, bound) with bounds that know how the ``HOT_NAMES`` most common names of a project overlap.

        A file counts those that refer to any of its hot names once; a file that refers to another of its names only where it refers to none of these.
        So what is added up are counts of files by name and by the set of hot names they refer to, never pairs of files.
        """
        target, name = ["project_id", "target_file"], ["project_id", "name"]
        used = self.references.select(*name, "source_file").distinct()
        users = used.groupBy(*name).agg(F.count(F.lit(1)).alias("b"))
        hot = cut_lineage(top_k_per_group(users, ["project_id"], [F.desc("b"), F.asc("name")], HOT_NAMES).select(
            *name, F.call_function("shiftleft", F.lit(1), F.col("rank").cast("int") - 1).alias("bit")))
        refers = used.join(hot, name, "left").groupBy("project_id", "source_file").agg(F.coalesce(F.bit_or("bit"), F.lit(0)).alias("set"))
        refers = cut_lineage(refers)
        sets = lambda df, *keys: df.groupBy(*keys, "set").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
            F.collect_list(F.struct("set", "n")).alias("sets"))  # at most 2^HOT_NAMES
        added = lambda found: F.aggregate(F.filter("sets", found), F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
        defined = self.definitions.select(*target, "name").distinct().join(rest.select(*target), target, "left_semi").join(hot, name, "left")
        own = defined.groupBy(*target).agg(F.coalesce(F.bit_or("bit"), F.lit(0)).alias("own"))
        every = own.select("project_id", "own").distinct().join(sets(refers, "project_id"), "project_id").select(
            "project_id", "own", added(lambda x: x["set"].bitwiseAND(F.col("own")) != 0).alias("hot"))
        cold = defined.filter("bit is null").select(*target, "name").join(own, target)
        cold = cold.join(sets(used.join(refers, ["project_id", "source_file"]), *name), name).select(
            *target, added(lambda x: x["set"].bitwiseAND(F.col("own")) == 0).alias("n"))
        parts = own.join(every, ["project_id", "own"]).select(*target, F.col("hot").alias("n")).unionByName(cold).unionByName(
            imported.groupBy(*target).agg(F.count(F.lit(1)).alias("n")))
        least = parts.groupBy(*target).agg(F.sum("n").alias("least"))
        return rest.join(least, target, "left").select(*target, F.least("bound", "least").alias("bound"))

    def _counted(self, rest: DataFrame, imported: DataFrame, may_win: Column) -> DataFrame:
        """(project_id, target_file, n) of those of rest(project_id, target_file, bound) that ``may_win``: counted in one block of referring
        files, then in eight times as many, and so on. Files go as soon as those of the blocks to come couldn't make up for what they lack.
        Of many files fewer blocks are counted at once."""
        target = ["project_id", "target_file"]
        blocks = int(self._sources.agg(F.max("block")).first()[0] or 0) + 1
        low = 0
        rest = rest.withColumn("_seen", F.lit(0).cast("bigint"))
        while low < blocks and not rest.isEmpty():
            names = self.definitions.join(rest.select(*target), target, "left_semi").count()
            most = WAVE_ROWS // max(1, names)
            high = blocks if low + most >= blocks else low + max(1, min(7 * low or 1, most))
            unseen = self._sources.groupBy("project_id").agg(F.count_if(F.col("block") >= high).alias("_unseen"))
            found = self._block_referrers(rest, imported, low, high)
            more = rest.join(found, target, "left").join(unseen, "project_id", "left")
            seen = F.col("_seen") + F.coalesce("n", F.lit(0))
            least = F.least("bound", seen + F.coalesce("_unseen", F.lit(0)))
            rest = cut_lineage(more.select(*target, least.alias("bound"), seen.alias("_seen")).filter(may_win))
            low = high
        return rest.select(*target, F.col("_seen").alias("n")).filter("n > 0")


# ---------------------------------------------------------------- lookups in edge rows


def related(edges: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """Out- and in-edges of symbols(*keys, project_id, file, name)."""
    s = symbols.select(*keys, "project_id", "file", "name")
    out = edges.join(
        s.withColumnsRenamed({"file": "source_file", "name": "source_symbol"}),
        ["project_id", "source_file", "source_symbol"],
    ).select(*keys, F.col("target_file").alias("file"), F.col("target_symbol").alias("symbol"), "kind", F.lit("out").alias("direction"), "n")
    into = edges.join(
        s.withColumnsRenamed({"file": "target_file", "name": "target_symbol"}),
        ["project_id", "target_file", "target_symbol"],
    ).select(*keys, F.col("source_file").alias("file"), F.col("source_symbol").alias("symbol"), "kind", F.lit("in").alias("direction"), "n")
    return out.unionByName(into)


def impacted(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Dependents of the given files(project_id, file)."""
    return edges.join(
        files.select("project_id", F.col("file").alias("target_file")).distinct(), ["project_id", "target_file"]
    ).select(
        "project_id", F.col("target_file").alias("file"), F.col("source_file").alias("dependent"), "kind",
        F.col("source_symbol").alias("symbol"), "n",
    )


def edge_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("edges"))


def parse_symbol_refs(refs: DataFrame, listing: DataFrame, root: Column, ref: str = "ref") -> DataFrame:
    """``file:name`` references to existing files; others drop out.

    refs(project_id, ref, ...); relative paths are taken from ``root``.
    """
    text = F.trim(ref)
    file = F.regexp_extract(text, r"(?s)^(.*):([^:]+)$", 1)
    absolute = F.when(file.startswith("/") | (root == ""), file).otherwise(
        normalize_path(F.concat(root, F.lit("/"), file))
    )
    parsed = refs.withColumn("file", F.when(file != "", absolute)).withColumn(
        "name", F.regexp_extract(text, r"(?s)^(.*):([^:]+)$", 2)
    )
    return parsed.filter(F.col("file").isNotNull() & (F.col("name") != "")).join(
        listing.select("project_id", "file").distinct(), ["project_id", "file"], "left_semi"
    )


def resolve_names(names: DataFrame, listing: DataFrame, root: Column, name: str = "name") -> DataFrame:
    """Existing file of a bare name, by probing the known extensions under ``root``."""
    base = names.withColumn("_base", F.concat(root, F.lit("/"), F.col(name)))
    return probe(base, "_base", listing, dims.NAME_SUFFIXES, "resolved").drop("_base")
