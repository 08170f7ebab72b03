"""Canonical documents: order, rename, refusal, and reading back."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomgraph.plans.schema import EDGES, FILES, NODES, Graph
from loomgraph.sources import document, graph_files


def graph(spark, parts=3):
    nodes = [(f"n{k:03}", "function", f'a "quoted" {k}\nline', "p/ü.py", "python", k, k + 1, "") for k in range(120)] + [("", "external", ",{", "", "", 0, 0, "")]
    edges = [(f"n{k % 120:03}", f"n{k * 7 % 120:03}", ("calls", "imports")[k % 2], "p", k % 13, k) for k in range(300)] + [("n001", "n002", "calls", "p", 2, 3)] * 2
    files = [("p/ü.py", "parsed", "python", "", 10, "ab", 3, 4), ("]}", "skipped", "", "symlink", 0, "", 0, 0)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(parts)
    return Graph(make(nodes, NODES), make(edges, EDGES), make(files, FILES))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same(one, other):
    return all(rows(getattr(one, t)) == rows(getattr(other, t)) for t in ("nodes", "edges", "files"))


def test_documents_are_canonical_and_come_back(spark, tmp_path):
    g = graph(spark)
    path = tmp_path / "graph.json"
    found = document.write_document(g, str(path), str(tmp_path))
    text = path.read_bytes()
    whole = json.loads(text)
    assert whole["digest"] == found == document.digest_of(spark, str(path)) and whole["format"] == document.FORMAT
    assert [n["id"] for n in whole["nodes"]] == sorted(n["id"] for n in whole["nodes"]) and len(whole["nodes"]) == 121
    order = [(e["src"], e["type"], e["dst"], e["path"], e["line"], e["col"]) for e in whole["edges"]]
    assert order == sorted(order) and len(order) == 302
    assert same(document.read_document(spark, str(path)), g)
    # another partitioning gives the same bytes, another row another digest
    document.write_document(graph(spark, 7), str(path), str(tmp_path))
    assert path.read_bytes() == text
    changed = Graph(g.nodes, g.edges.withColumn("col", F.when(F.col("col") == 5, 6).otherwise(F.col("col"))), g.files)
    assert document.write_document(changed, str(path), str(tmp_path)) != found and path.read_bytes() != text
    assert os.listdir(tmp_path) == ["graph.json"]


def test_documents_of_others_and_empty_ones(spark, tmp_path):
    other = tmp_path / "other.json"
    other.write_text(json.dumps({"version": 1, "nodes": [{"id": "a", "kind": "file"}], "edges": [{"src": "a", "dst": "b", "line": 2}], "files": []}, indent=1))
    got = document.read_document(spark, str(other))
    assert rows(got.nodes) == [("a", "file", "", "", "", 0, 0, "")] and rows(got.edges) == [("a", "b", "", "", 2, 0)] and rows(got.files) == []
    assert document.digest_of(spark, str(other)) is None
    none = Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
    document.write_document(none, str(tmp_path / "none.json"), str(tmp_path))
    assert {k: v for k, v in json.loads((tmp_path / "none.json").read_text()).items() if k in ("nodes", "edges", "files")} == {"nodes": [], "edges": [], "files": []}
    back = document.read_document(spark, str(tmp_path / "none.json"))
    assert back.nodes.count() == back.edges.count() == back.files.count() == 0


def test_nothing_is_written_outside_the_root(spark, tmp_path):
    root, outside = tmp_path / "root", tmp_path / "root2"
    root.mkdir()
    outside.mkdir()
    os.symlink(outside, root / "link")
    for target in (outside / "g.json", root / "link" / "g.json", root / ".." / "g.json", root):
        with pytest.raises(document.OutsideRoot):
            document.write_document(graph(spark), str(target), str(root))
    assert os.listdir(outside) == [] and os.listdir(root) == ["link"]


def test_a_failed_write_leaves_the_old_document(spark, tmp_path):
    folder = tmp_path / ".loomgraph"
    folder.mkdir()
    path = folder / "graph.json"
    document.write_document(graph(spark), str(path), str(tmp_path))
    text = path.read_bytes()
    g = graph(spark)
    broken = Graph(g.nodes.withColumn("name", F.when(F.col("id") == "n007", F.raise_error(F.lit("lost"))).otherwise(F.col("name"))), g.edges, g.files)
    with pytest.raises(Exception, match="lost"):
        document.write_document(broken, str(path), str(tmp_path))
    assert path.read_bytes() == text
    # a folder of ours leaves itself out of commits, and a file that is there is left alone
    assert sorted(n for n in os.listdir(folder) if not n.endswith(".crc")) == [".gitignore", "graph.json"]
    (folder / ".gitignore").write_text("mine")
    document.write_document(g, str(path), str(tmp_path))
    assert (folder / ".gitignore").read_text() == "mine"


def test_old_generations_of_a_cache_go(spark, tmp_path):
    schema = {"facts": "path string, n int"}
    for n in range(4):
        graph_files.write_cache({"facts": spark.createDataFrame([("a", n)], schema["facts"])}, str(tmp_path / "cache"))
        assert [r.n for r in graph_files.read_cache(spark, str(tmp_path / "cache"), schema)["facts"].collect()] == [n]
    assert len([n for n in os.listdir(tmp_path / "cache") if not n.startswith(".")]) == 3
