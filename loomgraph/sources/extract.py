"""Definitions, imports and calls of source files, as joins over a table of lines.

A scan of each file blanks strings and comments (``lexical``).  Files explode to
lines; the patterns of their language find definitions, imports and calls;
running sums of braces (or indents) give each definition its range; interval
joins promote functions to methods and find the caller of each call;
``resolve_calls`` binds the calls.  Files with unbalanced brackets are
``partial``, and give what is outside of the damage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators.resolve import innermost, promoted_methods, resolve_calls
from loomgraph.operators.windows import running_sum
from loomgraph.plans.schema import EDGE_COLUMNS, Graph, first_rows, node_id
from loomgraph.plans.storage import stash
from loomgraph.sources import graph_files, lexical
from loomgraph.sources.languages import EXTENSIONS, LANGUAGES, NOISE, Language


def language_of(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair)), ext)


def languages_of(rows: DataFrame) -> list[Language]:
    there = {r.language for r in rows.select("language").distinct().collect()}
    return [lang for lang in LANGUAGES if lang.name in there]


def each_language(rows: DataFrame, make: Callable[[DataFrame, Language], DataFrame], there: list[Language], label: str) -> DataFrame:
    """A table of ``make`` of the rows of each language that is there.

    So each expression has the patterns of one language only, and compiles, and
    what reads the table does not carry them all along."""
    parts = [make(rows.where(F.col("language") == lang.name), lang) for lang in there]
    return stash(reduce(DataFrame.unionByName, parts) if parts else make(rows.limit(0), LANGUAGES[0]), label)


def classified(scan: DataFrame, max_total_bytes: int = 256 << 20) -> DataFrame:
    """Status, language and scanned code of each file; unknown extensions are
    ``unsupported``, noise is left out.

    Only sources that were read count towards ``max_total_bytes``: the first one
    over it is reported, those after it are dropped.  The sum carries no content,
    and where all sources together are within it, no running sum is needed."""
    ext = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    files = scan.withColumn("language", F.coalesce(language_of(F.col("name")), F.lit("")))
    files = files.where((F.col("language") != "") | (ext != "") & ~ext.isin(*NOISE))
    has_nul = F.col("content").isNotNull() & F.contains(F.substring("content", 1, 8192), F.lit(b"\0"))
    known = F.col("status") != ""
    counted = (F.col("language") != "") & ~known & F.col("content").isNotNull()
    sizes = files.where(counted).select("walk_order", "size")
    if (sizes.agg(F.sum("size")).first()[0] or 0) > max_total_bytes:
        used = running_sum(sizes, "walk_order", F.col("size"), "_used").drop("size")
        files = files.join(used, "walk_order", "left").select(*files.columns, F.coalesce("_used", F.lit(0)).alias("_used"))
    else:
        files = files.withColumn("_used", F.lit(0))
    files = files.where(~counted | (F.col("_used") - F.col("size") <= max_total_bytes))
    readable = counted & (F.col("_used") <= max_total_bytes) & ~has_nul & F.is_valid_utf8("content")
    by_indent = F.col("language").isin(*(lang.name for lang in LANGUAGES if lang.nesting == "indent"))
    files = files.withColumn("_scan", lexical.scan(F.when(readable, F.col("content").cast("string")), "language", by_indent))
    why = (
        F.when(F.col("language") == "", F.struct(F.lit("unsupported").alias("s"), F.concat(F.lit("no grammar for '"), ext, F.lit("'")).alias("r")))
        .when(known, F.struct(F.col("status").alias("s"), F.col("reason").alias("r")))
        .when(F.col("_used") > max_total_bytes, F.struct(F.lit("skipped").alias("s"), F.lit("total_bytes_exceeded").alias("r")))
        .when(has_nul, F.struct(F.lit("skipped").alias("s"), F.lit("binary").alias("r")))
        .when(~F.is_valid_utf8("content"), F.struct(F.lit("unparsed").alias("s"), F.lit("utf8_decode_error").alias("r")))
        .when(F.col("_scan.broken"), F.struct(F.lit("partial").alias("s"), F.lit("syntax_errors_present").alias("r")))
        .otherwise(F.struct(F.lit("parsed").alias("s"), F.lit("").alias("r")))
    )
    found = {"status": F.col("_why.s"), "reason": F.col("_why.r"), "code": F.col("_scan.code"), "within": F.col("_scan.within"), "ahead": F.col("_scan.ahead"), "unfinished": F.col("_scan.unfinished")}
    return files.withColumn("_why", why).withColumns(found).drop("_why", "_used", "_scan")


def _count(column: Column, mark: str) -> Column:
    return F.length(column) - F.length(F.replace(column, F.lit(mark), F.lit("")))


#: Files that give definitions, imports and calls.
_READ = "status in ('parsed', 'partial')"


def lines(files: DataFrame, there: list[Language] | None = None) -> DataFrame:
    """Pieces of lines: ``line``, ``shift`` (bytes before the piece), ``seq`` (its
    place in the file), ``body``, ``look`` (it and what is ahead of its line, for
    the last piece of a line), whether it is ``unfinished`` there, the nesting ``before`` and ``after`` it, and
    whether its line starts ``within`` brackets or a string.  The braces of a
    broken file say nothing, so its indents nest.

    Where braces nest, a line is cut after each of ``{``, ``}`` and ``;``, so
    that several definitions on a line are each at the start of a piece."""
    parsed = files.where(_READ)
    return each_language(parsed, _lines, languages_of(parsed) if there is None else there, "lines")


def _lines(files: DataFrame, lang: Language) -> DataFrame:
    # dealt by path as whole contents, which the running sums of their lines can use
    whole = files.select("path", "language", "walk_order", "status", "code", "within", "ahead", "unfinished").repartition("path")
    each = F.arrays_zip(F.split("code", "\r?\n", -1).alias("whole"), F.col("within").alias("within"), F.col("ahead").alias("ahead"), F.col("unfinished").alias("unfinished"))
    split = whole.select("path", "language", "walk_order", "status", F.posexplode(each).alias("at", "each"))
    split = split.select("path", "language", "walk_order", "at", "each.whole", "each.within", "each.ahead", "each.unfinished", (F.lit(lang.nesting == "brace") & (F.col("status") == "parsed")).alias("braced"))
    split = split.withColumn("pieces", F.when(F.col("braced"), F.split("whole", r"(?<=[{};])", -1)).otherwise(F.array("whole")))
    split = split.select("path", "language", "walk_order", "braced", "within", "ahead", "unfinished", "at", "pieces", F.posexplode("pieces").alias("nth", "body"))
    last = F.trim(F.array_join(F.slice("pieces", F.col("nth") + 2, F.size("pieces")), "")) == ""
    split = split.withColumn("look", F.when((F.col("ahead") != "") & last, F.concat("body", "ahead")).otherwise(F.col("body"))).drop("ahead")
    split = split.withColumn("unfinished", F.coalesce(F.col("unfinished") & last & ~F.rlike(F.rtrim("body"), F.lit("[{};]$")), F.lit(False)))
    shift = F.octet_length(F.array_join(F.slice("pieces", F.lit(1), F.col("nth")), ""))
    code = F.col("body")
    split = split.withColumn("change", _count(code, "{") - _count(code, "}")).withColumn("blank", (F.trim(code) == "") & ~F.col("within")).withColumn("shift", shift)
    split = split.withColumn("seq", F.col("at").cast("bigint") * (1 << 20) + F.col("nth")).withColumn("line", F.col("at") + 1)
    after = F.sum("change").over(Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    indent = F.length(F.regexp_extract("body", r"^(\s*)", 1))
    split = split.withColumn("total", after)
    return split.select(
        "path",
        "language",
        "walk_order",
        "line",
        "shift",
        "seq",
        "body",
        "look",
        "unfinished",
        "blank",
        "within",
        F.when(F.col("braced"), F.col("total") - F.col("change")).otherwise(indent).alias("before"),
        F.when(F.col("braced"), F.col("total")).otherwise(indent).alias("after"),
        "braced",
    )


def _listed(kind: str, pattern: str, label: str) -> Column:
    """An array of (label, name, col): the names of the comma list that the pattern's second group holds."""
    items = F.split(F.regexp_extract("body", pattern, 2), ",")
    start = F.octet_length(F.regexp_extract("body", pattern, 1))
    before = lambda k: F.octet_length(F.array_join(F.slice(items, F.lit(1), k), ",")) + F.when(k > 0, 1).otherwise(0)
    name = lambda x: F.regexp_extract(x, r"^\s*([^\s,]+)", 1)
    blank = lambda x: F.octet_length(F.regexp_extract(x, r"^(\s*)", 1))
    listed = F.transform(items, lambda x, k: F.struct(F.lit(kind).alias(label), name(x).alias("name"), (start + before(k) + blank(x)).alias("col")))
    return F.when(F.rlike("body", F.lit(pattern)), listed).otherwise(F.array().cast(f"array<struct<{label}:string,name:string,col:int>>"))


def _called(lang: Language) -> Column:
    """An array of (label, name, col) of the calls in a piece; the places follow from the matches in order."""
    skip = ", ".join(f"'{k}'" for k in lang.keywords)
    pattern = lang.calls.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(
        f"transform(filter(aggregate(regexp_extract_all(body, '{pattern}', 1), named_struct('p', 1, 'out', cast(array() as array<struct<name:string,at:int>>)),"
        " (s, m) -> named_struct('p', locate(m, body, s.p) + length(m), 'out', concat(s.out, array(named_struct('name', m, 'at', locate(m, body, s.p)))))).out,"
        f" x -> not blank and x.name not in ({skip})), x -> named_struct('label', 'calls', 'name', x.name, 'col', octet_length(substring(body, 1, x.at - 1))))"
    )


def hits(rows: DataFrame, there: list[Language] | None = None) -> DataFrame:
    """(path, language, walk_order, line, seq, before, braced, label, name, col)
    of all that the patterns find, in one pass: ``label`` is the kind of a
    definition, ``imports`` or ``calls``."""

    def found(of: DataFrame, lang: Language) -> DataFrame:
        patterns = [*lang.definitions, *(("imports", p) for p in lang.imports)]
        of_ = lambda k: "body" if k == "imports" else "look"
        hit = lambda k, p: F.struct(F.lit(k).alias("label"), F.regexp_extract(of_(k), p, 2).alias("name"), F.octet_length(F.regexp_extract(of_(k), p, 1)).alias("col"))
        # most pieces meet no pattern, and are looked at once for each
        single = lambda k, p: F.when(F.rlike(of_(k), F.lit(p)), hit(k, p))
        made = [single(k, p) for k, p in patterns if p not in lang.lists]
        each = [_listed(k, p, "label") for k, p in patterns if p in lang.lists]
        listed = F.filter(F.concat(F.array(*made), *each), lambda h: h["name"] != "")
        every = of.select("path", "language", "walk_order", "line", "shift", "seq", "before", "braced", F.explode(F.concat(listed, _called(lang))).alias("hit"))
        return every.select("path", "language", "walk_order", "line", "seq", "before", "braced", "hit.label", "hit.name", (F.col("shift") + F.col("hit.col")).alias("col"))

    return each_language(rows, found, languages_of(rows) if there is None else there, "hits")


def definitions(rows: DataFrame, found: DataFrame) -> DataFrame:
    """path, kind, name, line, col, end_line, and the range [lo, hi) of pieces of
    each definition that ``found`` has in the pieces ``rows``; functions in
    classes promoted to methods, constants dropped where another definition has
    their name and line.

    All of it is dealt by path once: a file is bounded, so no path is too hot."""
    raw = found.where("label not in ('imports', 'calls')").withColumnRenamed("label", "kind").repartition("path")
    first = F.min(F.struct("seq", "col", "language", "walk_order", "before", "braced")).alias("f")
    raw = raw.groupBy("path", "kind", "name", "line").agg(first).select("path", "kind", "name", "line", "f.*")
    shadowed = F.max(F.col("kind") != "constant").over(Window.partitionBy("path", "name", "line"))
    raw = raw.withColumn("_shadowed", shadowed).where("kind != 'constant' or not _shadowed").drop("_shadowed")
    # a range closes at the next piece that is no deeper: with braces the one that brings the
    # nesting back, with indents the line before it; else at the file's last piece.  Pieces meet
    # the levels that their file's definitions have, and one running window a level finds the
    # next, without pairing rows.
    low = F.when(F.col("unfinished"), 1 << 30).when(F.col("braced"), F.col("after")).when(F.col("within"), 1 << 30).otherwise(F.col("before"))
    full = rows.where("not blank").select("path", low.alias("low"), F.struct(F.col("seq").alias("at"), F.col("line").alias("there")).alias("here")).repartition("path")
    in_file = Window.partitionBy("path").orderBy("here.at")
    full = full.withColumns({"prior": F.lag("here").over(in_file), "last": F.lead("here").over(in_file).isNull()})
    levels = raw.groupBy("path").agg(F.collect_set("before").alias("levels"))
    closes = F.explode(F.filter("levels", lambda x: F.col("last") | (F.col("low") <= x))).alias("level")
    events = full.join(levels, "path").select("path", closes, "low", "here", "prior")
    before = F.when(F.col("low") <= F.col("level"), F.col("prior")).otherwise(F.col("here"))
    events = events.select("path", "level", F.col("here.at").alias("at"), F.lit(1).alias("tie"), F.struct("here", before.alias("prior")).alias("close"))
    rest = F.struct("language", "walk_order", "kind", "name", "line", "col", "braced")
    starts = raw.select("path", F.col("before").alias("level"), F.col("seq").alias("at"), F.when(F.col("braced"), 0).otherwise(2).alias("tie"), rest.alias("start"))
    backward = Window.partitionBy("path", "level").orderBy(F.desc("at"), F.desc("tie")).rowsBetween(Window.unboundedPreceding, -1)
    closed = events.unionByName(starts, allowMissingColumns=True).withColumn("next", F.last("close", ignorenulls=True).over(backward)).where("start is not null")
    closed = closed.select("path", "start.*", F.col("at").alias("lo"), "next")
    end = F.coalesce(F.when(F.col("braced"), F.col("next.here")).otherwise(F.col("next.prior")), F.struct(F.col("lo").alias("at"), F.col("line").alias("there")))
    whole = closed.withColumn("end", end).select("path", "language", "walk_order", "kind", "name", "line", "col", F.col("end.there").cast("int").alias("end_line"), "lo", (F.col("end.at") + 1).alias("hi"))
    whole = stash(whole, "ranges")
    methods = promoted_methods(whole.where("kind = 'function'"), whole.where("kind in ('class', 'interface')")).select("path", "name", "line", "lo").withColumn("_method", F.lit(True))
    promoted = whole.join(methods, ["path", "name", "line", "lo"], "left")
    return promoted.withColumn("kind", F.when((F.col("kind") == "function") & F.col("_method"), F.lit("method")).otherwise(F.col("kind"))).drop("_method")


def imports(found: DataFrame) -> DataFrame:
    """path, language, walk_order, name, line, col of each import, once a line."""
    named = found.where("label = 'imports'").withColumn("name", text.unquoted(F.col("name")))
    return named.select("path", "language", "walk_order", "name", "line", "col").dropDuplicates(["path", "name", "line"])


def calls(found: DataFrame) -> DataFrame:
    """path, name, line, col, seq of each call."""
    return found.where("label = 'calls'").select("path", "walk_order", "name", "line", "seq", "col")


#: What a file gives by itself, whatever the others hold, and which version of it.
_FACTS = {
    "definitions": "path string, name string, line int, lo bigint, language string, walk_order bigint, kind string, col int, end_line int, hi bigint, id string",
    "imports": "path string, language string, walk_order bigint, name string, line int, col int",
    "calls": "path string, name string, line int, col int, seq bigint, src string",
}
_PARSED = "path string, sha256 string"


def facts(files: DataFrame) -> dict[str, DataFrame]:
    """Definitions, imports and calls (with their callers) of classified files."""
    there = languages_of(files.where(_READ))
    rows = lines(files, there)
    found = hits(rows, there)
    defs = definitions(rows, found)
    defs = stash(defs.withColumn("id", node_id(F.col("kind"), F.col("name"), F.col("path"), F.col("line"))), "definitions")
    heads = defs.select("path", "name", "line", F.col("lo").alias("seq"))
    made = calls(found).join(heads, ["path", "name", "line", "seq"], "left_anti")
    owners = defs.where("kind != 'constant'").select("path", "lo", "hi", "id")
    made = innermost(made.select("path", "name", "line", "col", "seq"), owners, "path", F.col("seq")).withColumnRenamed("enclosing", "src")
    made = made.withColumn("src", F.coalesce("src", F.concat(F.lit("file::"), F.col("path"))))
    return {"definitions": defs, "imports": stash(imports(found), "imports"), "calls": made}


def build(scan: DataFrame, cache: str | None = None, max_total_bytes: int = 256 << 20) -> Graph:
    """The property graph of a scan; each step is a table in the shared folder, so contents are read once.

    With a ``cache`` folder only files that it has not (by path and SHA-256)
    are extracted, and it holds the facts of all files of this scan afterwards."""
    measured = {"sha256": F.coalesce(F.sha2("content", 256), F.lit("")), "n_lines": text.line_count(F.col("content").cast("string"))}
    files = stash(classified(stash(scan, "scan"), max_total_bytes).withColumns(measured).drop("content"), "files")
    if not cache:
        return assemble(files, facts(files))
    parsed = files.where("status = 'parsed'").select("path", "sha256", "walk_order")
    old = graph_files.read_cache(files.sparkSession, cache, {"parsed": _PARSED, **_FACTS})
    same = stash(parsed.join(old["parsed"], ["path", "sha256"], "left_semi").select("path", "walk_order"), "same")
    fresh = facts(files.join(same, "path", "left_anti"))
    # the place of a file in the walk may have moved
    kept = lambda name: old[name].drop("walk_order").join(same, "path").select(*fresh[name].columns)
    found = {name: stash(fresh[name].unionByName(kept(name)), name) for name in _FACTS}
    graph_files.write_cache({"parsed": parsed.drop("walk_order"), **found}, cache)
    return assemble(files, found)


def assemble(files: DataFrame, found: dict[str, DataFrame]) -> Graph:
    """The graph of classified files and their facts: calls are bound, nodes and edges made."""
    defs, imported = found["definitions"], found["imports"]
    file_id = F.concat(F.lit("file::"), F.col("path"))
    resolved = stash(resolve_calls(found["calls"], defs.select("path", "name", "id")).select(*EDGE_COLUMNS), "resolved")
    known = files.where("status in ('parsed', 'partial')")

    edges = (
        defs.select(file_id.alias("src"), F.col("id").alias("dst"), F.lit("defines").alias("type"), "path", "line", "col")
        .unionByName(imported.select(file_id.alias("src"), F.concat(F.lit("external::"), "name").alias("dst"), F.lit("imports").alias("type"), "path", "line", "col"))
        .unionByName(resolved)
        .distinct()
    )
    node = lambda df, id_, kind, name, path, language, start, end, error, rank: df.select(id_.alias("id"), kind.alias("kind"), name.alias("name"), path.alias("path"), language.alias("language"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), error.alias("error"), rank.alias("rank"))
    none, zero, col = F.lit(""), F.lit(0), F.col
    last = F.lit(1 << 40).cast("bigint")
    loose = resolved.where("type = 'references'").select("dst").distinct()
    nodes = (
        node(known, file_id, F.lit("file"), F.element_at(F.split("path", "/"), -1), col("path"), col("language"), F.lit(1), col("n_lines"), none, col("walk_order"))
        .unionByName(node(files.where("status = 'unparsed'"), F.concat(file_id, F.lit("#unparsed")), F.lit("unparsed"), col("name"), col("path"), col("language"), zero, zero, col("reason"), col("walk_order")))
        .unionByName(node(defs, col("id"), col("kind"), col("name"), col("path"), col("language"), col("line"), col("end_line"), none, col("walk_order")))
        .unionByName(node(imported, F.concat(F.lit("external::"), "name"), F.lit("external"), col("name"), none, col("language"), zero, zero, none, col("walk_order")))
        .unionByName(node(loose, col("dst"), F.lit("external"), text.last_segment(col("dst")), none, none, zero, zero, none, last))
    )
    nodes = first_rows(nodes, ["id"], [col("rank"), col("language")]).drop("rank")
    per_file = defs.groupBy("path").agg(F.count("*").cast("int").alias("nodes"))
    reports = files.join(per_file, "path", "left").select("path", "status", "language", "reason", col("size").alias("bytes"), "sha256", F.coalesce("nodes", zero).alias("nodes"), zero.alias("edges"))
    return Graph(nodes, edges, reports)
