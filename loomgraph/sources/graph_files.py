"""Graphs on disk: Parquet tables, and the scan cache."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.schema import EDGES, FILES, NODES, Graph
from loomgraph.plans.storage import delete, exists, names_in

FORMAT = "loomgraph/1"
_TABLES = {"nodes": NODES, "edges": EDGES, "files": FILES}


def write(graph: Graph, path: str) -> None:
    """Three Parquet tables; nodes by kind and edges by type prune whole folders."""
    graph.nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
    if graph.files is not None:
        graph.files.write.mode("overwrite").parquet(f"{path}/files")


def read(spark: SparkSession, path: str, files: bool = True) -> Graph:
    get = lambda name: spark.read.schema(_TABLES[name]).parquet(f"{path}/{name}")
    return Graph(get("nodes"), get("edges"), get("files") if files else None)


def write_cache(facts: dict[str, DataFrame], path: str) -> None:
    """A new generation of the cache: one table for each kind of fact, and which generation holds.

    The generation before stays, for those that still read it; older ones go."""
    spark = next(iter(facts.values())).sparkSession
    generation, before = uuid.uuid4().hex, _holding(spark, path)
    for name, table in facts.items():
        table.write.parquet(f"{path}/{generation}/{name}")
    spark.createDataFrame([(FORMAT, generation)], "version string, generation string").write.mode("overwrite").json(f"{path}/current")
    for name in names_in(spark, path):
        if name not in ("current", generation, before):
            delete(spark, f"{path}/{name}")


def _holding(spark: SparkSession, path: str) -> str:
    """The generation that holds, '' without one."""
    if not exists(spark, f"{path}/current"):
        return ""
    try:
        row = spark.read.schema("version string, generation string").json(f"{path}/current").first()
    except (AnalysisException, Py4JError):
        return ""
    return row.generation or "" if row else ""


def read_cache(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of the cache that holds; empty ones if there is none, it has
    another version, or it can't be read."""
    empty = {name: spark.createDataFrame([], schema) for name, schema in schemas.items()}
    if not exists(spark, f"{path}/current"):
        return empty
    try:
        holds = spark.read.schema("version string, generation string").json(f"{path}/current").where(F.col("version") == FORMAT).first()
        if holds is None:
            return empty
        tables = {name: spark.read.schema(schema).parquet(f"{path}/{holds.generation}/{name}") for name, schema in schemas.items()}
        for table in tables.values():  # reads all of it once, so that a broken file shows here
            table.agg(F.count(F.struct("*"))).first()
        return tables
    except (AnalysisException, Py4JError):
        return empty


def changed(scan: DataFrame, cache: DataFrame) -> DataFrame:
    """Scanned files whose content the cache does not have: only these need a new extraction."""
    hashed = scan.withColumn("sha256", F.sha2("content", 256))
    return hashed.join(cache.select("path", "sha256"), ["path", "sha256"], "left_anti").select(*scan.columns)
