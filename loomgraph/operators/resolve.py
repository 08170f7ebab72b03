"""Joins that turn captured names and ranges into edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.storage import stash

#: Over so many candidates elsewhere a call stays unresolved.
MOST_CANDIDATES = 4
#: Definitions that a name's row holds at most.
MOST_HELD = 64


def resolve_calls(calls: DataFrame, definitions: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """Edges (src, dst, type, path, line, col), and ``ambiguous``, of each call.

    ``calls``: path, src, name, line, col.  ``definitions``: path, name, id; equal
    ones count once.  A name that the call's own file defines binds to all of these;
    else, with 1 to ``most`` definitions elsewhere, to all of those; else it references
    ``external::name``.  Bound to itself, a call is dropped.

    A name is one row with its definitions, or without them if it has over
    ``MOST_HELD``, so a call meets it once and never multiplies; definitions of such
    a name are met by file and name, in a join that is made only if there are any.
    The rows of names are a table of the shared folder."""
    held = max(most, MOST_HELD)
    rank = F.dense_rank().over(Window.partitionBy("name").orderBy("path", "id"))
    few = definitions.select("path", "name", "id").withColumn("_rank", rank).where(F.col("_rank") <= held + 1)
    few = few.groupBy("name").agg(F.collect_set(F.struct("path", "id")).alias("held"))
    few = stash(few.select("name", F.size("held").alias("n"), F.when(F.size("held") <= held, F.col("held")).alias("held")), "names")
    found = calls.join(few, "name", "left")
    ids = lambda rows: F.array_distinct(F.transform(rows, lambda x: x["id"]))
    local = F.filter("held", lambda x: x["path"] == F.col("path"))
    own = F.when(F.size(local) > 0, ids(local))
    often = few.where("held is null").select("name")
    if not often.isEmpty():
        many = definitions.join(often, "name", "left_semi").groupBy("path", "name").agg(F.collect_set("id").alias("_many"))
        found, own = found.join(many, ["path", "name"], "left"), F.coalesce("_many", own)
    found = found.select("src", "name", "path", "line", "col", "n", F.coalesce(own, F.when(F.col("n") <= most, ids("held"))).alias("_targets"))
    edge = lambda dst, type_, ambiguous: F.struct(dst.alias("dst"), F.lit(type_).alias("type"), ambiguous.cast("int").alias("ambiguous"))
    bound = F.transform(F.filter("_targets", lambda x: x != F.col("src")), lambda x: edge(x, "calls", F.lit(0)))
    loose = F.array(edge(F.concat(F.lit("external::"), F.col("name")), "references", F.coalesce("n", F.lit(0)) > most))
    edges = found.select("src", "path", "line", "col", F.inline(F.when(F.col("_targets").isNotNull(), bound).otherwise(loose)))
    return edges.select("src", "dst", "type", "path", "line", "col", "ambiguous")


def promoted_methods(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Functions (path, lo, hi, ...) strictly inside a class range of their file.

    One sweep over the sorted ranges of a file: of the classes that start before
    a function, or with it but end later, it matters only how far they reach.
    Rows without a path or an end are inside nothing; equal rows count each."""
    spans = lambda rows, kept: rows.select("path", "lo", "hi", kept.alias("_row"))
    rows = spans(functions, F.struct(*functions.columns)).unionByName(spans(classes.where("lo is not null"), F.lit(None).cast(functions.schema)))
    before = Window.partitionBy("path").orderBy("lo", F.desc("hi"), F.col("_row").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("_row").isNull(), F.col("hi"))).over(before)
    inside = rows.withColumn("_reach", reach).where("_row is not null and path is not null and lo is not null and _reach >= hi")
    return inside.select("_row.*")


def unshadowed_constants(constants: DataFrame, others: DataFrame) -> DataFrame:
    """Constants without another definition of the same name on the same line."""
    return constants.join(others.select("path", "name", "line"), ["path", "name", "line"], "left_anti")


def innermost(points: DataFrame, ranges: DataFrame, key: str, at: Column, order: str = "id") -> DataFrame:
    """Each distinct point with ``enclosing``: the id of the shortest range [lo, hi)
    of the same key around it (the least by ``order``, then id, of equals), or null.

    A range is cut into blocks: of each length 2**k, at multiples of it, two at
    most.  A point lies in one block of a length, so it meets all ranges around
    it by an equi-join on key and block.  Of a block only the best range is kept
    before, so a point meets a row a length at most, and a key with very many
    ranges or points is dealt by its blocks.  Empty ranges, and nulls, hold nothing."""
    size = (F.col("hi") - F.col("lo")).cast("bigint")
    shift = lambda c, k: F.call_function("shiftright", c.cast("bigint"), k)

    def cut(k: Column) -> Column:
        first, last = -shift(-F.col("lo"), k), shift(F.col("hi"), k)
        piece = lambda odd, block: F.when((first < last) & (odd.bitwiseAND(1) == 1), F.struct(k.alias("k"), block.alias("block")))
        return F.array_compact(F.array(piece(first, first), piece(last, last - 1)))

    whole = ranges.where("lo < hi").select(F.col(key).alias("_key"), "lo", "hi", F.struct(size.alias("size"), F.col(order).alias("order"), F.col("id").alias("id")).alias("range"))
    lengths = F.sequence(F.lit(0), F.length(F.bin(size)) - 1)
    blocks = whole.select("_key", F.inline(F.flatten(F.transform(lengths, cut))), "range").groupBy("_key", "k", "block").agg(F.min("range").alias("range"))
    longest = ranges.where("lo < hi").agg(F.max(F.length(F.bin(size)) - 1)).scalar()
    seats = points.select(F.struct(*points.columns).alias("_point"), F.col(key).alias("_key"), at.alias("_at"), F.explode_outer(F.sequence(F.lit(0), longest)).alias("k"))
    seats = seats.withColumn("block", shift(F.col("_at"), F.col("k")))
    found = seats.join(blocks, ["_key", "k", "block"], "left").groupBy("_point").agg(F.min("range").alias("range"))
    return found.select("_point.*", F.col("range.id").alias("enclosing"))


def dependency_signals(dependencies: DataFrame, signals: DataFrame) -> DataFrame:
    """Dependencies (name, ...) with their framework: the signal of the same
    lower-case name, else the first one (by ``ordinal``) that the name extends
    with ``-`` or ``/``.  The prefixes of a name are generated and equi-joined."""
    name = F.lower("name")
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda k: F.substring(name, k, F.lit(1)).isin("-", "/"))
    keys = F.array_distinct(F.concat(F.array(name), F.transform(cuts, lambda k: F.substring(name, F.lit(1), k - 1))))
    keyed = dependencies.withColumn("signal", F.explode(keys)).withColumn("_exact", F.col("signal") == name)
    hits = keyed.join(signals, "signal")
    best = F.min_by(F.struct("framework", "category"), F.struct(~F.col("_exact"), F.col("ordinal")))
    return hits.groupBy(*dependencies.columns).agg(best.alias("b")).select(*dependencies.columns, "b.framework", "b.category")
