"""Operators on property graphs: lookups, traversals, degrees, subgraphs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.policy import one_of
from loomgraph.plans.schema import DIRECTIONS, EDGE_COLUMNS, EDGE_TYPES, NODE_COLUMNS, Graph
from loomgraph.plans.storage import stash

# Rank of a node kind when an answer is pruned; others rank 5.
KIND_RANK = {"function": 0, "method": 0, "class": 1, "interface": 1, "constant": 2, "file": 2, "unparsed": 3, "external": 9}


def find_nodes(nodes: DataFrame, name: str = "", kind: str = "", language: str = "", path_prefix: str = "", exact: bool = False) -> DataFrame:
    """Nodes that meet all given selectors; '' is not given."""
    tests = []
    if name:
        tests.append(F.col("name") == name if exact else F.contains(F.lower("name"), F.lit(name.lower())))
    if kind:
        tests.append(F.col("kind") == kind)
    if language:
        tests.append(F.col("language") == language)
    if path_prefix:
        tests.append(F.col("path").startswith(path_prefix))
    return nodes.where(reduce(Column.__and__, tests, F.lit(True))).select(*NODE_COLUMNS)


def seeds(nodes: DataFrame, symbol: str) -> DataFrame:
    return nodes.where((F.col("name") == symbol) | (F.col("id") == symbol)).select("id")


def of_types(edges: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    """Edges of the given types; of all, if none is given."""
    return edges.where(F.col("type").isin(*(one_of(t, EDGE_TYPES, "edge type") for t in types))) if types else edges


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(here, there) with the edge's columns, for each way that it may be walked."""
    one_of(direction, DIRECTIONS, "direction")
    into = edges.select(F.col("dst").alias("here"), F.col("src").alias("there"), *EDGE_COLUMNS)
    out = edges.select(F.col("src").alias("here"), F.col("dst").alias("there"), *EDGE_COLUMNS)
    return {"callers": into, "callees": out, "both": into.union(out)}[direction]


def levels(graph: Graph, start: DataFrame, direction: str, depth: int, types: Sequence[str] = ()) -> DataFrame:
    """(id, depth) of what ``start`` reaches, level by level.

    Each level is written to the shared folder, so that a hop is one join of the
    edges with the level before; Spark broadcasts it while it is small."""
    walk = steps(of_types(graph.edges, types), direction).select("here", "there")
    frontier = stash(start.select("id").distinct().withColumn("depth", F.lit(0)), "level")
    seen = frontier
    for hop in range(1, depth + 1):
        new = walk.join(frontier.select(F.col("id").alias("here")), "here").select(F.col("there").alias("id")).distinct()
        frontier = stash(new.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(hop)), "level")
        seen = seen.union(frontier)
    return seen


def impact(graph: Graph, symbol: str, direction: str = "callers", depth: int = 2, types: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes that are reached (with their depth), and the edges that were walked
    from a node at less than the full depth."""
    reached = levels(graph, seeds(graph.nodes, symbol), direction, depth, types)
    nodes = graph.nodes.join(reached, "id").select(*NODE_COLUMNS, "depth")
    inner = reached.where(F.col("depth") < depth).select(F.col("id").alias("here"))
    return nodes, steps(of_types(graph.edges, types), direction).join(inner, "here", "left_semi").select(*EDGE_COLUMNS).distinct()


_TRAIL = "array<struct<type:string,dst:string,path:string,line:int,col:int,src:string>>"


def path_between(graph: Graph, source: str, target: str, max_depth: int = 5, types: Sequence[str] = ()) -> DataFrame:
    """The edges of the shortest directed path, numbered by ``step``; no rows if there is none.

    Of equally short ones the least start wins, then the least edges by (type,
    dst, path, line, col).  Ids alone walk on, a level after the other, up to
    the first that meets a target; from there edges are followed back, so that
    trails are laid only along shortest paths."""
    edges = of_types(graph.edges.select(*EDGE_COLUMNS), types)
    ends = seeds(graph.nodes, target).select(F.col("id").alias("at"))
    walked = [stash(seeds(graph.nodes, source).distinct().select(F.col("id").alias("start"), F.col("id").alias("at")), "level")]
    seen, back = walked[0], walked[0].limit(0)
    ways = edges.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    while len(walked) <= max_depth and back.isEmpty() and not walked[-1].isEmpty():
        new = walked[-1].join(ways, "at").select("start", F.col("next").alias("at")).distinct()
        walked.append(stash(new.join(seen, ["start", "at"], "left_anti"), "level"))
        seen = seen.union(walked[-1])
        back = walked[-1].join(ends, "at", "left_semi").select("start", "at")
    hops: list[DataFrame] = []
    for level in reversed(walked[:-1] if not back.isEmpty() else []):
        last = back.join(edges, F.col("at") == F.col("dst")).select("start", *EDGE_COLUMNS)
        hops.append(stash(last.join(level.withColumnRenamed("at", "src"), ["start", "src"], "left_semi"), "hops"))
        back = hops[-1].select("start", F.col("src").alias("at")).distinct()
    trails = back.withColumn("trail", F.array().cast(_TRAIL))
    hop = F.struct("type", "dst", "path", "line", "col", "src")
    for step in reversed(hops):
        longer = trails.join(step.withColumnRenamed("src", "at").withColumn("src", F.col("at")), ["start", "at"])
        trails = longer.groupBy("start", F.col("dst").alias("at")).agg(F.min(F.concat("trail", F.array(hop))).alias("trail"))
    e = F.col("e")
    best = trails.orderBy("start", "trail").limit(1)
    return best.select(F.posexplode("trail").alias("step", "e")).select("step", *(e[c].alias(c) for c in EDGE_COLUMNS))


def neighbors(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """Distinct ids one hop away: ``in``, ``out`` or ``both``."""
    one_of(direction, ("in", "out", "both"), "direction")
    into = edges.where(F.col("dst") == node).select(F.col("src").alias("id"))
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("id"))
    return {"in": into, "out": out, "both": into.union(out)}[direction].distinct()


def file_summary(graph: Graph, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a file, and edges with an end among them."""
    nodes = graph.nodes.where(F.col("path") == path).select(*NODE_COLUMNS)
    ids = nodes.select("id")
    edges = graph.edges.select(*EDGE_COLUMNS)
    by_src = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(*EDGE_COLUMNS)
    by_dst = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*EDGE_COLUMNS)
    return nodes, by_src.union(by_dst).distinct()


def summarize(graph: Graph) -> DataFrame:
    """(section, key, count): nodes by kind, edges by type, files by language and status."""
    count = lambda df, section, key: df.groupBy(F.col(key).alias("key")).count().select(F.lit(section).alias("section"), "key", "count")
    parts = [
        graph.nodes.agg(F.count("*").alias("count")).select(F.lit("nodes").alias("section"), F.lit("").alias("key"), "count"),
        graph.edges.agg(F.count("*").alias("count")).select(F.lit("edges").alias("section"), F.lit("").alias("key"), "count"),
        count(graph.nodes, "nodes_by_kind", "kind"),
        count(graph.edges, "edges_by_type", "type"),
    ]
    if graph.files is not None:
        parts += [count(graph.files.where("language != ''"), "files_by_language", "language"), count(graph.files, "files_by_status", "status")]
    return reduce(DataFrame.unionByName, parts)


def report(files: DataFrame, only_unparsed: bool = False) -> DataFrame:
    """Files that were not parsed without remark."""
    return files.where("status = 'unparsed'" if only_unparsed else "status != 'parsed' or reason != ''")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges in and out, parallel edges each."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def top_by_degree(graph: Graph, k: int) -> DataFrame:
    """The k nodes of greatest degree, then least id; nodes without edges have 0."""
    joined = graph.nodes.join(degrees(graph.edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))
    return joined.select(*NODE_COLUMNS, "degree").orderBy(F.desc("degree"), "id").limit(k)


def search(graph: Graph, text: str, k: int = 40) -> DataFrame:
    """The k nodes of greatest degree whose name has ``text`` in it, in any case."""
    found = find_nodes(graph.nodes, name=text)
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).join(found.select("id"), "id", "left_semi")
    ranked = found.join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))
    return ranked.select(*NODE_COLUMNS, "degree").orderBy(F.desc("degree"), "id").limit(k)


def labelled(graph: Graph, k: int = 160) -> DataFrame:
    """The k nodes that a drawing names: of greatest degree, externals left out."""
    return top_by_degree(Graph(graph.nodes.where("kind != 'external'"), graph.edges), k)


def induced_edges(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in ``keep`` (id)."""
    some = edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi")
    return some.join(keep.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def viewer_payload(graph: Graph, max_nodes: int = 6000, max_edges: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Top nodes by degree and the edges among them, both capped."""
    nodes = top_by_degree(graph, max_nodes)
    return nodes, induced_edges(graph.edges, nodes).orderBy("src", "type", "dst", "path", "line", "col").limit(max_edges)


def prune(nodes: DataFrame, max_nodes: int = 40, max_external: int = 6) -> DataFrame:
    """The nodes of highest rank: by kind, those with a path first, then by id;
    at most ``max_external`` externals.  Externals rank last, so two top-k
    passes do."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(r)) for k, r in KIND_RANK.items()), F.lit(5))
    by = (rank, F.col("path") == "", "id")
    external = nodes.where("kind = 'external'").orderBy(*by).limit(min(max_external, max_nodes))
    return nodes.where("kind != 'external'").orderBy(*by).limit(max_nodes).unionByName(external).orderBy(*by).limit(max_nodes)


def merge_edges(edges: DataFrame, order: list[Column]) -> DataFrame:
    """One edge for each (src, type, dst, line): the first by ``order``.

    Edges move before they are sorted: few are alike, and a sort where they come
    from would hold its rows beside those of what made them."""
    key = ("src", "type", "dst", "line")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return edges.repartition(*key).withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def citations(nodes: DataFrame) -> DataFrame:
    """Distinct ``path:line`` of nodes with a path."""
    return nodes.where("path != ''").select(F.concat_ws(":", "path", F.col("start_line").cast("string")).alias("citation")).distinct()


def rendered_edges(edges: DataFrame) -> DataFrame:
    """``src -[type]-> dst  path:line`` with the last segments of the ids."""
    last = lambda c: F.substring_index(c, "::", -1)
    return edges.select(F.format_string("%s -[%s]-> %s  %s:%d", last("src"), "type", last("dst"), "path", "line").alias("line"))


def node_radius(degree: Column, base: float = 2.0, scale: float = 1.0) -> Column:
    return (F.lit(base) + F.least(F.sqrt(degree) * 0.85, F.lit(7.0))) * scale


def bounds(layout: DataFrame) -> DataFrame:
    """Centre (cx, cy, cz) of the positions and the greatest distance from it."""
    centre = layout.agg(F.avg("x"), F.avg("y"), F.avg("z")).first()
    parts = [F.pow(F.col(c) - F.lit(v), 2) for c, v in zip("xyz", centre)]
    named = [F.lit(v).alias(f"c{c}") for c, v in zip("xyz", centre)]
    return layout.agg(F.max(F.sqrt(parts[0] + parts[1] + parts[2])).alias("radius")).select(*named, "radius")
