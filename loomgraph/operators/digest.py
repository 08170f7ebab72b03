"""A digest of tables by a Merkle tree over the hashes of their rows.

Rows are hashed, equal ones counted, and the hashes dealt by their first digits:
each group is digested in order, then the groups of groups, up to one root.  A
hash says where its row belongs, so no partitioning, order of files or order of
rows makes a difference, and any other value in any row does.  Groups at the
bottom hold a 16-millionth of the distinct rows each, above 256 digests each, and
copies of a row are one entry, however many.  A row moves once, as the bytes of
its hash, dealt by its first two; what is counted, sorted and digested down to
four digits is found where it is, and above there are 65,536 digests at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.schema import EDGE_COLUMNS, NODE_COLUMNS, Graph

#: Hexadecimal digits that the groups of each level share, from the bottom up.
LEVELS = (6, 4, 2, 0)


def row_hash(*columns: str) -> Column:
    """SHA-256 of a row; lengths before the values tell where each ends, and null from empty."""
    sized = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(*(F.coalesce(sized(F.col(c).cast("string")), F.lit("~")) for c in columns)), 256)


def merkle_root(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row (n, digest) of a table; of none, the digest of an empty text."""
    # bytes sort as their digits do; the first two are the first four digits
    level = rows.select(F.unhex(row_hash(*columns)).alias("at")).select(F.substring("at", 1, 2).alias("first"), "at")
    level = level.repartition("first").groupBy("first", "at").agg(F.count("*").alias("n")).withColumn("at", F.lower(F.hex("at")))
    level = level.withColumn("digest", F.concat_ws(":", "at", F.col("n").cast("string")))
    for digits in LEVELS:
        inner = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        where_it_is = ["first"] if digits >= 4 else []
        level = level.groupBy(*where_it_is, F.substring("at", 1, digits).alias("at")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(inner, ","), 256).alias("digest"))
    # no group comes of no rows
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"))


def graph_root(graph: Graph) -> DataFrame:
    """(part, n, digest) of the nodes, the edges, the files if there are any, and, over these, of the graph."""
    tables = {"nodes": (graph.nodes, NODE_COLUMNS), "edges": (graph.edges, EDGE_COLUMNS)}
    if graph.files is not None:
        tables["files"] = (graph.files, tuple(graph.files.columns))
    parts = reduce(DataFrame.union, [merkle_root(rows, tuple(columns)).select(F.lit(name).alias("part"), "n", "digest") for name, (rows, columns) in tables.items()])
    inner = F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"])
    whole = parts.agg(F.sum("n").alias("n"), F.sha2(F.array_join(inner, ","), 256).alias("digest")).select(F.lit("graph").alias("part"), "n", "digest")
    return parts.union(whole)
