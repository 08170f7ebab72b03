"""A graph as one canonical JSON document, written whole or not at all.

The document has a row on each line, in total orders, so equal graphs give equal
bytes however they are partitioned, and a reader can split the file at lines.
Its head holds the Merkle digest of the graph.

Writing: the lines become a table of the shared folder, one task sorts them
(with spills) into a part file beside the target, and a rename puts it in the
target's place: a reader sees the old document or the new one.  That is one
task by the nature of one file; ``graph_files.write`` has the tables for graphs
of any size.  A target outside of the root, also by links, is refused before
anything is written.

Edge cases: repeated rows stay; null columns are left out of a row and read as
'' or 0; an empty graph has empty lists; further columns are not written.
"""

from __future__ import annotations

import json
import os
import uuid
from contextlib import suppress
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import digest
from loomgraph.plans.schema import EDGES, FILES, NODES, Graph
from loomgraph.plans.storage import drop_stash, stash
from loomgraph.sources.repository import OWN

FORMAT = "loomgraph/2"
_TABLES = {"nodes": NODES, "edges": EDGES, "files": FILES}
#: What orders each list; the rest of a row follows as text.
_ORDERS = {"nodes": ("id",), "edges": ("src", "type", "dst", "path", "line", "col"), "files": ("path",)}
IGNORED = "# what this library writes here is local\n*\n"


class OutsideRoot(PermissionError):
    """The target does not lie in the root."""


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _path(spark: SparkSession, path: str):
    """The Hadoop path of a name, and its file system; relative names and ``..`` are resolved."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(where)


def _resolved(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The place that a name stands for, and whether it is on a local disk; links are followed there."""
    _, where = _path(spark, path)
    if where.toUri().getScheme() == "file":
        return os.path.realpath(where.toUri().getPath()), True
    return where.toString(), False


def target_in(spark: SparkSession, path: str, root: str) -> str:
    """The resolved target, if it lies in the root."""
    (target, local), (base, base_local) = _resolved(spark, path), _resolved(spark, root)
    if local != base_local or not target.startswith(base.rstrip("/") + "/"):
        raise OutsideRoot(f"{path} is not in {root}: nothing was written")
    return target


def _lines(graph: Graph) -> DataFrame:
    """section, order, text of each row."""
    tables = {"nodes": graph.nodes, "edges": graph.edges, "files": graph.files}
    found = []
    for section, (name, schema) in enumerate(_TABLES.items()):
        if tables[name] is None:
            continue
        columns = [c for c in _columns(schema) if c in tables[name].columns]
        rows = tables[name].select(*columns)
        row = F.to_json(F.struct(*columns))
        # numbers order as numbers, and null before all else
        first = [F.coalesce(F.lpad(F.col(c).cast("string"), 20, "0") if rows.schema[c].dataType.typeName() in ("integer", "long") else F.concat(F.lit("="), c), F.lit("")) for c in _ORDERS[name] if c in columns]
        found.append(rows.select(F.lit(section).alias("section"), F.array(*first, row).alias("order"), row.alias("text")))
    return reduce(DataFrame.unionAll, found)


def _framed(lines: DataFrame, head: str) -> DataFrame:
    """section, place, order, tie, text: the rows with commas before all but the first, and what stands around the lists."""
    firsts = {r.section: r.tie for r in lines.groupBy("section").agg(F.min_by("tie", F.struct("order", "tie")).alias("tie")).collect()}  # a row for each list
    opens: Column = reduce(lambda a, b: a | b, [(F.col("section") == s) & (F.col("tie") == t) for s, t in firsts.items()], F.lit(False))
    rows = lines.select("section", F.lit(1).alias("place"), "order", "tie", F.concat(F.when(opens, "").otherwise(","), "text").alias("text"))
    frame = [(k, 0, [""], 0, (head if k == 0 else "],") + f'\n"{name}":[') for k, name in enumerate(_TABLES)] + [(len(_TABLES), 0, [""], 0, "]}")]
    return rows.unionAll(lines.sparkSession.createDataFrame(frame, "section int, place int, order array<string>, tie bigint, text string"))


def _replace(spark: SparkSession, part: str, target: str) -> None:
    """Renames a file over another in one step."""
    fs, where = _path(spark, target)
    if where.toUri().getScheme() == "file":
        os.replace(_path(spark, part)[1].toUri().getPath(), where.toUri().getPath())
        return
    jvm = spark._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), fs.getConf()).rename(_path(spark, part)[1], where, how)


def self_ignoring(spark: SparkSession, folder: str) -> None:
    """A ``.gitignore`` in a folder of ours that leaves all of it out, unless one is there; no run fails for it."""
    with suppress(Py4JJavaError):
        fs, where = _path(spark, f"{folder}/.gitignore")
        if not fs.exists(where):
            out = fs.create(where, False)
            try:
                out.write(IGNORED.encode())
            finally:
                out.close()


def write_document(graph: Graph, path: str, root: str) -> str:
    """Writes the graph to the file ``path`` in ``root`` and returns its digest."""
    spark = graph.nodes.sparkSession
    target = target_in(spark, path, root)
    folder = target.rpartition("/")[0]
    parts = f"{folder}/.{uuid.uuid4().hex}"
    columns = lambda df, name: df.select(*(c for c in _columns(_TABLES[name]) if c in df.columns))
    whole = Graph(columns(graph.nodes, "nodes"), columns(graph.edges, "edges"), None if graph.files is None else columns(graph.files, "files"))
    root_digest = digest.graph_root(whole).where("part = 'graph'").first().digest
    # a table, so that a row keeps its number
    lines = stash(_lines(whole).withColumn("tie", F.monotonically_increasing_id()), "lines")
    fs, _ = _path(spark, parts)
    try:
        head = json.dumps({"format": FORMAT, "digest": root_digest})[:-1] + ","
        ordered = _framed(lines, head).repartition(1).sortWithinPartitions("section", "place", "order", "tie")
        ordered.select("text").write.text(parts)
        name = next(s.getPath().toString() for s in fs.listStatus(_path(spark, parts)[1]) if s.getPath().getName().startswith("part-"))
        if os.path.basename(folder).startswith(OWN):
            self_ignoring(spark, folder)
        _replace(spark, name, target)
    finally:
        fs.delete(_path(spark, parts)[1], True)
        drop_stash(lines)
    return root_digest


def read_document(spark: SparkSession, path: str) -> Graph:
    """The graph of a document.  One of ours is split at its lines; another one, with
    the lists ``nodes``, ``edges`` and ``files``, is a single row of one task."""
    if (head := spark.read.text(path).first()) is not None and head.value.startswith(json.dumps({"format": FORMAT})[:-1]):
        rows = spark.read.text(path).where(~F.col("value").startswith('"') & F.col("value").rlike("^,?\\{") & ~F.col("value").startswith(json.dumps({"format": FORMAT})[:-1]))
        row = F.regexp_replace("value", "^,", "")
        # no two lists have rows with the same columns
        own = {"nodes": "kind", "edges": "src", "files": "status"}
        tables = []
        for name, schema in _TABLES.items():
            parsed = rows.select(F.from_json(row, schema).alias("r")).select("r.*")
            tables.append(parsed.where(F.col(own[name]).isNotNull()))
    else:
        schema = ", ".join(f"{k} array<struct<{', '.join(':'.join(c.split()) for c in v.split(', '))}>>" for k, v in _TABLES.items())
        whole = spark.read.schema(schema).json(path, multiLine=True)
        tables = [whole.select(F.inline(name)) for name in _TABLES]
    return Graph(*(df.na.fill("").na.fill(0) for df in tables))


def digest_of(spark: SparkSession, path: str) -> str | None:
    """The digest that a document of ours states."""
    head = spark.read.text(path).first()
    try:
        return json.loads(head.value.rstrip(",") + "}").get("digest") if head else None
    except ValueError:
        return None
