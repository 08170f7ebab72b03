"""The data model: typed property graphs as three DataFrames.

Absent values are '' or 0, never null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "id string, kind string, name string, path string, language string, start_line int, end_line int, error string"
EDGES = "src string, dst string, type string, path string, line int, col int"
FILES = "path string, status string, language string, reason string, bytes bigint, sha256 string, nodes int, edges int"
DETECTIONS = "name string, category string, evidence string, detail string"

# The closed enumerations of the model.
KINDS = ("file", "function", "method", "class", "interface", "constant", "external", "unparsed")
EDGE_TYPES = ("calls", "imports", "defines", "references")
STATUSES = ("parsed", "partial", "unparsed", "skipped", "unsupported")
DIRECTIONS = ("callers", "callees", "both")

NODE_COLUMNS = ("id", "kind", "name", "path", "language", "start_line", "end_line")
EDGE_COLUMNS = ("src", "dst", "type", "path", "line", "col")


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame | None = None

    def persist(self) -> Graph:
        for df in (self.nodes, self.edges, self.files):
            if df is not None:
                df.persist()
        return self

    def stored(self) -> Graph:
        """The same graph with its edges in a table of the shared folder, for operators that read them often."""
        from loomgraph.plans.storage import stash

        return Graph(self.nodes, stash(self.edges, "edges"), self.files)


def node_id(kind: Column, name: Column, path: Column, line: Column) -> Column:
    return (
        F.when(kind == "file", F.concat(F.lit("file::"), path))
        .when(kind == "external", F.concat(F.lit("external::"), name))
        .otherwise(F.concat(path, F.lit("::"), kind, F.lit(":"), name, F.lit("@"), line.cast("string")))
    )


def checked(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Fails the job on a value outside a closed enumeration."""
    bad = ~F.col(column).isin(*allowed)
    return df.withColumn(column, F.when(bad, F.raise_error(F.concat(F.lit(f"unknown {column} "), F.col(column)))).otherwise(F.col(column)))


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: first writer wins.  Aggregates before it shuffles."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return best.select(*keys, *(F.col(f"_first.{c}").alias(c) for c in rest)).select(*df.columns)
