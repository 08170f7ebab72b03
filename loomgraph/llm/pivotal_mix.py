"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source gets a target; a document is to be taken ``target / source size``
times, mostly a fraction.  The whole part is certain.  The fractions of two
documents of one source are then paired: mass (words) moves from one to the
other, at random in the direction that keeps every expectation, until one of
the two is wholly taken or wholly left out.  The other goes on to the next
pair.  The pairs form a reduction tree: documents are dealt by hash into
groups of about ``FAN_IN``, each group folds to one residual, and the
residuals are dealt again, until one a source is left, which a coin settles.
A document that is large for its group would settle one small partner after
another and stay fractional itself, up to the last coin.  It is therefore
paired with the bundle of all documents after it (``large``: the share of the
group's words from which on): mass moves until the document is integral, and
the bundle's common probability gives or gets it.  So a source's words miss its
target by less than a small document's size, and no task ever holds more than a
group, however large a source is.

Sources are ordered by code point, null last.  Edge cases: a null or empty
text has size 0 and is taken 0 times with certainty.  Repeated rows (equal id,
source and size) are one item with so many rows, and share its copies evenly.
No rows, no result.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import LAST_ID, WORD_PATTERN, stash

FAN_IN = 256
#: Share of its group's words from which on a document is paired with a bundle.
LARGE = 1 / 64

_DECIDED = "array<struct<id:{id},source:string,size:bigint,source_size:bigint,target:double,n:bigint,base:bigint,up:int>>"
_RESIDUAL = "struct<id:{id},source:string,size:bigint,source_size:bigint,target:double,n:bigint,base:bigint,w:double,m:double,salt:bigint>"


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the number of words of each row."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of("text").alias("size"))


def targets(items: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size, target, of each source: ``share`` of all sizes by
    weight, each at most ``cap`` times the source's size and the excess
    shared again.  Capped are those whose size for a weight is least."""
    by = Window.orderBy(F.col("source").asc_nulls_last())
    per = items.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    per = per.withColumn("at", F.row_number().over(by) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("at") % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    up = Window.orderBy(F.col("most") / F.col("weight"), "at")
    before = F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("full", (F.col("total") - before) * F.col("weight") >= F.col("most") * left)
    everywhere = Window.partitionBy()
    rate = (F.col("total") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everywhere)) / F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everywhere)
    return per.select("source", "source_size", "rows", F.when(F.col("full"), F.col("most")).otherwise(rate * F.col("weight")).alias("target"))


def _step() -> str:
    """Pairs the residual ``s.r`` with the next item ``x``; gives the new state."""
    decided = "named_struct('id', {0}.id, 'source', {0}.source, 'size', {0}.size, 'source_size', {0}.source_size, 'target', {0}.target, 'n', {0}.n, 'base', {0}.base, 'up', {1})"
    rest = "named_struct('id', {0}.id, 'source', {0}.source, 'size', {0}.size, 'source_size', {0}.source_size, 'target', {0}.target, 'n', {0}.n, 'base', {0}.base, 'w', {0}.w, 'm', {1}, 'salt', {0}.salt)"

    def out(item: str, up: int) -> str:
        return decided.format(item, up)

    def state(done: list[str], residual: str) -> str:
        return f"named_struct('out', concat(s.out, array({', '.join(done)})), 'r', {residual})"

    none = "if(true, null, x)"
    # a: mass that can move from x to r, b: from r to x, u: a number in [0, 1) fixed by the two
    amounts = "named_struct('a', least(s.r.w - s.r.m, x.m), 'b', least(s.r.m, x.w - x.m), 'u', (xxhash64(s.r.salt, x.salt, {seed}L) & 9007199254740991L) / 9007199254740992D)"
    fills = f"if(s.r.w - s.r.m < x.m, {state([out('s.r', 1)], rest.format('x', 'x.m - y.a'))}, if(s.r.w - s.r.m > x.m, {state([out('x', 0)], rest.format('s.r', 's.r.m + y.a'))}, {state([out('s.r', 1), out('x', 0)], none)}))"
    drains = f"if(s.r.m < x.w - x.m, {state([out('s.r', 0)], rest.format('x', 'x.m + y.b'))}, if(s.r.m > x.w - x.m, {state([out('x', 1)], rest.format('s.r', 's.r.m - y.b'))}, {state([out('s.r', 0), out('x', 1)], none)}))"
    paired = f"element_at(transform(array({amounts}), y -> if(y.u * (y.a + y.b) < y.b, {fills}, {drains})), 1)"
    return f"if(s.r is null, named_struct('out', s.out, 'r', x), {paired})"


def _pooled(id_type: str, seed: int, large: float) -> str:
    """Settles the large items of ``xs`` (sorted, largest first) against the
    pool of those after them; gives out (decided) and rest (with their new mass)."""
    item, decided = f"array<{_RESIDUAL.format(id=id_type)}>", _DECIDED.format(id=id_type)
    sums = "aggregate(filter(xs, z -> z.n = 1), named_struct('m', 0D, 's', 0D), (t, z) -> named_struct('m', t.m + z.m, 's', t.s + z.w))"
    start = f"named_struct('m', y.m, 's', y.s, 'out', cast(array() as {decided}), 'rest', cast(array() as {item}))"
    settled = "named_struct('id', x.id, 'source', x.source, 'size', x.size, 'source_size', x.source_size, 'target', x.target, 'n', x.n, 'base', x.base, 'up', {0})"
    take = f"named_struct('m', t.m - x.w, 's', t.s - x.w, 'out', concat(t.out, array({settled.format(1)})), 'rest', t.rest)"
    leave = f"named_struct('m', t.m, 's', t.s - x.w, 'out', concat(t.out, array({settled.format(0)})), 'rest', t.rest)"
    share = "least(greatest(t.m / t.s, 0D), 1D) * x.w"
    changed = f"named_struct('id', x.id, 'source', x.source, 'size', x.size, 'source_size', x.source_size, 'target', x.target, 'n', x.n, 'base', x.base, 'w', x.w, 'm', {share}, 'salt', x.salt)"
    wait = f"named_struct('m', t.m - {share}, 's', t.s - x.w, 'out', t.out, 'rest', concat(t.rest, array({changed})))"
    apart = "named_struct('m', t.m, 's', t.s, 'out', t.out, 'rest', concat(t.rest, array(x)))"
    coin = f"(xxhash64(x.salt, {seed + 1}L) & 9007199254740991L) / 9007199254740992D * t.s < t.m"
    one = f"if(x.n > 1, {apart}, if(x.w > y.s * {float(large)!r}D and x.w <= t.m and x.w <= t.s - t.m, if({coin}, {take}, {leave}), {wait}))"
    return f"element_at(transform(array({sums}), y -> aggregate(xs, {start}, (t, x) -> {one})), 1)"


def _fold(items: DataFrame, id_type: str, seed: int, group: Column, large: float) -> DataFrame:
    """Folds each group of a source's fractional items: out (decided), r (the residual or null)."""
    start = f"named_struct('out', p.out, 'r', cast(null as {_RESIDUAL.format(id=id_type)}))"
    listed = items.groupBy("source", group.alias("grp")).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("x.w")).alias("rank"), F.col("x.salt").alias("salt"), F.col("x").alias("x")))).alias("xs")
    )
    listed = listed.select(F.expr("transform(xs, z -> z.x)").alias("xs"))
    pooled = listed.select(F.expr(_pooled(id_type, seed, large)).alias("p"))
    folded = F.expr(f"aggregate(p.rest, {start}, (s, x) -> {_step().format(seed=seed)})")
    return pooled.select(folded.alias("s")).select("s.out", "s.r")


def mix(items: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 1, large: float = LARGE) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each row of
    ``sizes()``: ``copies`` is how often the mix has the row."""
    id_type = items.schema["doc_id"].dataType.simpleString()
    items = stash(items, "sizes")
    per = stash(targets(items, weights, share, cap), "targets")
    levels, most = 1, per.agg(F.max("rows")).first()[0] or 0
    while most > FAN_IN:
        levels, most = levels + 1, -(-most // FAN_IN)
    joined = items.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).join(per, items["source"].eqNullSafe(per["source"])).drop(per["source"])
    mass = F.when(F.col("size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("base", F.floor(mass).cast("long")).withColumn("x", mass - F.floor(mass))
    fixed = ["size", "source_size", "target", "n", "base"]
    whole = joined.where("x = 0").select(F.col("doc_id").alias("id"), "source", *fixed, F.lit(0).alias("up"))
    w = F.col("size").cast("double")
    item = F.struct(F.col("doc_id").alias("id"), "source", *fixed, w.alias("w"), (F.col("x") * w).alias("m"), F.xxhash64("doc_id", "source", "size", F.lit(seed)).alias("salt"))
    rows = joined.where("x > 0").select("source", "rows", item.alias("x"))
    results, width = [whole], FAN_IN
    for level in range(levels):
        groups = F.ceil(F.col("rows") / width) if level < levels - 1 else F.lit(1)
        folded = _fold(rows, id_type, seed, F.pmod(F.shiftright(F.col("x.salt"), 7), groups), large)
        done = folded.select(F.explode("out").alias("d")).select("d.*")
        results.append(done)
        rest = folded.where("r is not null").select(F.col("r.source").alias("source"), F.col("r").alias("x"))
        rows = rest.join(per.select(F.col("source").alias("of"), "rows"), F.col("source").eqNullSafe(F.col("of"))).select("source", "rows", "x")
        width *= FAN_IN
    coin = F.expr(f"cast((xxhash64(x.salt, {seed}L) & 9007199254740991L) / 9007199254740992D < x.m / x.w as int)")
    results.append(rest.select("x.id", "x.source", *(f"x.{c}" for c in fixed), coin.alias("up")))
    decided = results[0]
    for one in results[1:]:
        decided = decided.unionByName(one)
    copies = F.col("base") + F.col("up")
    each = F.expr("explode(sequence(1L, n))")
    shared = decided.withColumn("total", copies).withColumn("k", each)
    return shared.select(
        F.col("id").alias("doc_id"),
        "source",
        "size",
        "source_size",
        "target",
        (F.floor(F.col("total") / F.col("n")) + (F.col("k") <= F.col("total") % F.col("n")).cast("long")).cast("long").alias("copies"),
    ).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix has it."""
    key = F.coalesce("doc_id", F.lit(LAST_ID)).cast("long").alias("key")
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("of")
    keys = ["key", "of", "size"]
    decided = mix(sizes(docs), **options).select(key, source, "size", "copies").groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    each = F.floor(F.col("copies") / F.col("n")) + (F.col("nth") <= F.col("copies") % F.col("n")).cast("long")
    rows = docs.select(F.struct("*").alias("row"), key, source, size_of("text").alias("size")).join(decided, keys)
    rows = rows.withColumn("nth", nth).withColumn("each", each).where("each > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("each"))).alias("k")).select("row.*")
