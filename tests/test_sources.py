"""Scans, extraction and stacks on trees made here."""

import json

import pytest

from loomgraph import cli
from loomgraph.operators.policy import QueryCaps
from loomgraph.plans import settings
from loomgraph.sources import extract, graph_files, models, stacks
from loomgraph.sources.languages import EXTENSIONS, LANGUAGES
from loomgraph.sources.repository import RepositorySource


def scan(spark, root, **options):
    spark.dataSource.register(RepositorySource)
    reader = spark.read.format("repository").option("root", str(root))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def write(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return root


SHOP = {
    "shop/cart.py": "import decimal\nfrom shop.tax import rate\n\nLIMIT = 10\n\n\nclass Cart:\n    def total(self, items):\n        return sum_up(items) + rate()\n\n\ndef sum_up(items):\n    return sum(items)\n",
    "shop/tax.py": "def rate():\n    return 3\n",
    "shop/wrong.py": "def wrong(:\n    oops(((\n",
    "web/page.js": 'import { show } from "./view.js";\n\nexport function load(id) {\n  return show(id);\n}\n',
    "web/view.js": "export function show(id) {\n  return fetch(id);\n}\n",
    "till/till.go": 'package shop\n\nimport "fmt"\n\ntype Till struct{}\n\nfunc (t Till) Ring(n int) {\n\tfmt.Println(n)\n}\n\nfunc start() {\n\tt := Till{}\n\tt.Ring(2)\n}\n',
    "shop/loop.py": "def again():\n    return again()\n",
    "notes.csv": "a,b\n",
    "README.md": "x",
}


def test_graph_of_a_small_tree(spark, tmp_path):
    """All nodes and edges with their places, and no others."""
    graph = extract.build(scan(spark, write(tmp_path, SHOP)))
    nodes = sorted((r.kind, r.name, r.path, r.start_line, r.end_line) for r in graph.nodes.collect())
    assert nodes == sorted(
        [
            ("file", "cart.py", "shop/cart.py", 1, 14),
            ("file", "loop.py", "shop/loop.py", 1, 3),
            ("file", "tax.py", "shop/tax.py", 1, 3),
            ("file", "wrong.py", "shop/wrong.py", 1, 3),
            ("file", "till.go", "till/till.go", 1, 15),
            ("file", "page.js", "web/page.js", 1, 6),
            ("file", "view.js", "web/view.js", 1, 4),
            ("class", "Cart", "shop/cart.py", 7, 9),
            ("class", "Till", "till/till.go", 5, 5),
            ("method", "total", "shop/cart.py", 8, 9),
            ("method", "Ring", "till/till.go", 7, 9),
            ("function", "sum_up", "shop/cart.py", 12, 13),
            ("function", "again", "shop/loop.py", 1, 2),
            ("function", "rate", "shop/tax.py", 1, 2),
            ("function", "start", "till/till.go", 11, 14),
            ("function", "load", "web/page.js", 3, 5),
            ("function", "show", "web/view.js", 1, 3),
            ("constant", "LIMIT", "shop/cart.py", 4, 4),
            *(("external", name, "", 0, 0) for name in ("decimal", "shop.tax", "fmt", "./view.js", "sum", "Println", "fetch")),
        ]
    )
    edges = sorted((r.src.split("::")[-1], r.type, r.dst.split("::")[-1], r.line, r.col) for r in graph.edges.collect())
    assert edges == sorted(
        [
            ("shop/cart.py", "defines", "constant:LIMIT@4", 4, 0),
            ("shop/cart.py", "defines", "class:Cart@7", 7, 0),
            ("shop/cart.py", "defines", "method:total@8", 8, 4),
            ("shop/cart.py", "defines", "function:sum_up@12", 12, 0),
            ("shop/loop.py", "defines", "function:again@1", 1, 0),
            ("shop/tax.py", "defines", "function:rate@1", 1, 0),
            ("till/till.go", "defines", "class:Till@5", 5, 5),
            ("till/till.go", "defines", "method:Ring@7", 7, 0),
            ("till/till.go", "defines", "function:start@11", 11, 0),
            ("web/page.js", "defines", "function:load@3", 3, 7),
            ("web/view.js", "defines", "function:show@1", 1, 7),
            ("shop/cart.py", "imports", "decimal", 1, 7),
            ("shop/cart.py", "imports", "shop.tax", 2, 5),
            ("till/till.go", "imports", "fmt", 3, 7),
            ("web/page.js", "imports", "./view.js", 1, 22),
            ("method:total@8", "calls", "function:sum_up@12", 9, 15),
            ("method:total@8", "calls", "function:rate@1", 9, 31),
            ("function:start@11", "calls", "method:Ring@7", 13, 3),
            ("function:load@3", "calls", "function:show@1", 4, 9),
            ("function:sum_up@12", "references", "sum", 13, 11),
            ("method:Ring@7", "references", "Println", 8, 5),
            ("function:show@1", "references", "fetch", 2, 9),
        ]
    )
    files = {r.path: (r.status, r.reason) for r in graph.files.collect()}
    assert files["shop/wrong.py"] == ("partial", "syntax_errors_present")
    assert files["notes.csv"] == ("unsupported", "no grammar for '.csv'")
    assert "README.md" not in files
    sources = extract.build(scan(spark, tmp_path, withContent="sources"))
    assert sorted(map(tuple, sources.edges.collect())) == sorted(map(tuple, graph.edges.collect()))

    graph_files.write(graph, str(tmp_path / "out"))
    again = graph_files.read(spark, str(tmp_path / "out"))
    assert again.nodes.count() == graph.nodes.count() and again.edges.count() == graph.edges.count()
    cache = spark.createDataFrame([(r.path, r.sha256) for r in graph.files.collect()], "path string, sha256 string")
    write(tmp_path, {"shop/tax.py": "def rate():\n    return 4\n"})
    fresh = graph_files.changed(scan(spark, tmp_path, exclude="out,cache"), cache)
    assert "shop/tax.py" in {r.path for r in fresh.collect()} and "web/view.js" not in {r.path for r in fresh.collect()}


def test_incremental_build(spark, tmp_path, monkeypatch):
    """Only what changed is extracted, the graph is that of a whole build, and a broken cache counts as none."""
    root, cache = tmp_path / "tree", str(tmp_path / "cache")
    write(root, {"a.py": "import os\ndef one():\n    return two()\n", "b.py": "def two():\n    return 2\n", "c.js": "function three(){ return one(); }\n"})
    rows = lambda g: (sorted(map(tuple, g.nodes.collect())), sorted(map(tuple, g.edges.collect())))
    taken, whole_facts = [], extract.facts

    def facts(files):
        taken.append({r.path for r in files.where("status = 'parsed'").collect()})
        return whole_facts(files)

    monkeypatch.setattr(extract, "facts", facts)
    assert rows(extract.build(scan(spark, root), cache)) == rows(extract.build(scan(spark, root)))
    write(root, {"b.py": "def two():\n    return one()\n", "0.py": "x = 1\n"})
    assert rows(extract.build(scan(spark, root), cache)) == rows(extract.build(scan(spark, root)))
    assert taken[0] == {"a.py", "b.py", "c.js"} and taken[2] == {"b.py", "0.py"}
    for f in (tmp_path / "cache").rglob("*.parquet"):
        f.write_bytes(b"broken")
    assert rows(extract.build(scan(spark, root), cache)) == rows(extract.build(scan(spark, root)))
    assert taken[4] == {"0.py", "a.py", "b.py", "c.js"}


def test_deadline(spark, tmp_path):
    write(tmp_path, {"a.py": "x = 1\n", "b.py": "x = 1\n"})
    assert {(r.status, r.reason) for r in scan(spark, tmp_path, maxSeconds=-1.0).collect()} == {("skipped", "wall_clock_exceeded")}


def test_toml_manifests(spark, tmp_path):
    project = """
[project]
dependencies = ["flask>=3", "numpy", # a remark
  "celery[redis]"]
optional-dependencies.test = ["pytest"]
[tool.poetry]
dependencies = {django = "5", redis = {version = "1"}}
[tool.poetry.group.dev.dependencies]
pandas = "2"
"""
    assert stacks.toml_dependencies(project) == ["flask", "numpy", "celery", "pytest", "django", "redis", "pandas"]
    assert stacks.toml_dependencies("dependencies.axum = '1'") == ["axum"] and stacks.toml_dependencies("= bad") == stacks.toml_dependencies("project = 3") == []
    found = {r.name for r in stacks.detect(scan(spark, write(tmp_path, {"pyproject.toml": project, "x/Cargo.toml": "= bad"}))).collect()}
    assert found == {"Python", "Flask", "NumPy", "Celery", "pytest", "Django", "Redis client", "pandas", "Rust"}


def test_settings():
    env = {"LOOMGRAPH_MAX_FILES": "7", "LOOMGRAPH_MAX_DEPTH": "-1", "LOOMGRAPH_MAX_WALL_SECONDS": "2.5", "LOOMGRAPH_MAX_FILE_BYTES": "x", "LOOMGRAPH_QUERY_MAX_NODES": " 9 "}
    assert settings.of(settings.Limits, env=env) == settings.Limits(max_files=7, max_wall_seconds=2.5)
    assert settings.of(QueryCaps, env=env, prefix="query_") == QueryCaps(max_nodes=9)
    assert settings.truth(" Yes ") and not settings.truth("0") and settings.truth(None, True)
    settings.check_start({})
    settings.check_start({"LOOMGRAPH_ENV": "production", "LOOMGRAPH_MODEL_KEY": "k"})
    with pytest.raises(settings.StartupError):
        settings.check_start({"LOOMGRAPH_ENV": " Production "})


def test_model_lists(spark):
    body = json.dumps({"data": [{"id": "b/x", "name": "X", "context_length": 128000, "pricing": {"prompt": "0.0000015", "completion": "0"}}, {"id": "a/free", "pricing": {"prompt": 0}}, {"name": "no id"}, 3, {"id": "c", "pricing": {"prompt": "?"}}]})
    frame = spark.createDataFrame([(body,), ("{",), ("{}",), (None,)], "body string")
    found = models.parse(frame)
    assert [(r.id, r.name, r.context_length, r.prompt_price, r.completion_price, r.free) for r in found.orderBy("id").collect()] == [("a/free", "a/free", None, 0.0, None, True), ("b/x", "X", 128000, 1.5e-6, 0.0, False), ("c", "c", None, None, None, False)]
    assert [r.id for r in models.free_only(found).collect()] == ["a/free"]
    assert [(r.context, r.price) for r in models.price_label(found).orderBy("id").collect()] == [("?", "free"), ("128,000", "$0.0000015/token"), ("?", "?")]


def test_commands(spark, tmp_path, capsys, monkeypatch):
    """Each command through ``main``."""
    root, graph = tmp_path / "tree", str(tmp_path / "graph")
    write(root, {"a.py": "def one(key):\n    password = 'hunter2hunter2'\n    return two()\n", "b.py": "def two():\n    return 2\n", "requirements.txt": "flask\n"})
    (tmp_path / "models.json").write_text(json.dumps({"data": [{"id": "m", "pricing": {"prompt": 0}}]}))

    def told(*argv):
        assert cli.main(list(argv)) == 0, argv
        return capsys.readouterr().out

    assert json.loads(told("map", str(root), graph, "--cache", str(tmp_path / "cache")))["nodes"] == 4
    assert "hunter2" not in told("impact", graph, "one", "--direction", "both", "--root", str(root)) and "hunter2" not in told("explain", graph, "one", "--root", str(root))
    assert "`two`" in told("ask", graph, "what is two?") and json.loads(told("path", graph, "one", "two"))["edges"]
    for argv in (("find", graph, "one"), ("file", graph, "a.py"), ("stats", graph), ("report", graph), ("stacks", str(root)), ("models", str(tmp_path / "models.json"), "--free"), ("tools",), ("doctor",)):
        assert told(*argv)
    shown = told("impact", graph, "one", "--direction", "both", "--root", str(root), "--text")
    assert "  function  two                              b.py:1\n" in shown and "  function:one@1 -[calls]-> function:two@1  a.py:3\n" in shown and "  | " in shown and "hunter2" not in shown
    health = json.loads(told("doctor"))
    assert health["languages_ready"] == f"{len(LANGUAGES)} of {len(LANGUAGES)}" and health["limits"]["max_files"] == 5000 and health["query_caps"]["max_nodes"] == 200 and health["ok"]
    assert cli.main(["map", str(root), graph, "--json", str(tmp_path / "out.json")]) == 1 and not (tmp_path / "out.json").exists()
    told("map", str(root), graph, "--json", str(root / "out.json"))
    assert len(json.loads((root / "out.json").read_text())["nodes"]) == 4
    assert cli.main(["find", graph, ""]) == 2 and cli.main(["impact", graph, "one", "--direction", "up"]) == 1
    monkeypatch.setenv("LOOMGRAPH_ENV", "production")
    assert cli.main(["doctor"]) == 78


# one line of each language: definitions, a call, an import
SAMPLES = {
    "python": ("import sys\nclass Box:\n    def size(self):\n        return measure(2)\ndef measure(n): return n\n", {"Box", "size", "measure"}, "measure", "sys"),
    "javascript": ('import zip from "zip";\nclass Box { size(){ return measure(2); } }\nfunction measure(n){ return n; }\n', {"Box", "size", "measure"}, "measure", "zip"),
    "typescript": ('import {Z} from "./z";\ninterface Sized { a: number }\nfunction measure(n: number){ return n; }\nclass Box { size(){ measure(2); } }\n', {"Sized", "Box", "measure", "size"}, "measure", "./z"),
    "tsx": ('import View from "view";\nfunction Box(){ return measure(2); }\nfunction measure(n: number){ return n; }\n', {"Box", "measure"}, "measure", "view"),
    "go": ('package main\nimport "os"\ntype Box struct{}\nfunc (b Box) Size() { measure() }\nfunc measure() { os.Exit(2) }\n', {"Box", "Size", "measure"}, "measure", "os"),
    "rust": ("use std::io;\nstruct Box2;\nfn measure(n: i32) -> i32 { n }\nfn size() -> i32 { measure(2) }\n", {"Box2", "measure", "size"}, "measure", "std::io"),
    "java": ("package a;\nimport java.util.Map;\nclass Box { int size(){ return measure(); } int measure(){ return 2; } }\n", {"Box", "size", "measure"}, "measure", "java.util.Map"),
    "c": ("#include <math.h>\nint measure(int n){return n;}\nint size(){return measure(2);}\nstruct Box{int a;};\n", {"measure", "size", "Box"}, "measure", "math.h"),
    "cpp": ("#include <map>\nnamespace store { class Box { public: int size(){ return measure(); } }; }\nint measure(){return 2;}\n", {"Box", "store", "measure"}, "measure", "map"),
    "c_sharp": ("using System;\nnamespace Store { class Box { int Size(){ return Measure(); } int Measure(){ return 2; } } }\n", {"Box", "Size", "Measure"}, "Measure", "System"),
    "ruby": ('require "set"\nclass Box\n  def size\n    measure(2)\n  end\nend\ndef measure(n); n; end\n', {"Box", "size", "measure"}, "measure", None),
    "php": ("<?php\nuse Store\\Box;\nclass Bin { function size(){ return measure(2); } }\nfunction measure($n){ return $n; }\n", {"Bin", "size", "measure"}, "measure", "Store\\Box"),
    "bash": ("measure() { echo 2; }\nsize() { measure; }\n", {"measure", "size"}, "measure", None),
    "kotlin": ("import kotlin.math.abs\nclass Box { fun size(): Int = measure(2) }\nfun measure(n: Int): Int = n\n", {"Box", "size", "measure"}, "measure", "kotlin.math.abs"),
    "swift": ("import Darwin\nclass Box { func size() -> Int { return measure(2) } }\nfunc measure(_ n: Int) -> Int { return n }\n", {"Box", "size", "measure"}, "measure", "Darwin"),
    "scala": ("import java.io\nclass Box { def size(): Int = measure(2) }\ndef measure(n: Int): Int = n\n", {"Box", "size", "measure"}, "measure", "java"),
    "lua": ("function measure(n) return n end\nfunction size() return measure(2) end\n", {"measure", "size"}, "measure", None),
    "sql": ("CREATE TABLE boxes (id INT);\nSELECT * FROM boxes WHERE id=2;\n", {"boxes"}, "boxes", None),
}


def test_every_language(spark, tmp_path):
    assert set(SAMPLES) == {lang.name for lang in LANGUAGES} and len(EXTENSIONS) == 37
    first = {lang.name: lang.extensions[0] for lang in LANGUAGES}
    write(tmp_path, {f"{k}/a{first[k]}": v[0] for k, v in SAMPLES.items()})
    files = extract.classified(scan(spark, tmp_path)).persist()
    assert {r.language: r.status for r in files.collect()} == dict.fromkeys(SAMPLES, "parsed")
    rows = extract.lines(files).persist()
    defined, called, imported = {}, {}, {}
    hits = extract.hits(rows).persist()
    for r in extract.definitions(rows, hits).collect():
        defined.setdefault(r.language, set()).add(r.name)
    for r in extract.calls(hits).collect():
        called.setdefault(r.path.split("/")[0], set()).add(r.name)
    for r in extract.imports(hits).collect():
        imported.setdefault(r.language, set()).add(r.name.strip('"'))
    for k, (_, names, call, module) in SAMPLES.items():
        assert names <= defined[k], (k, defined[k])
        assert call in called[k], (k, called[k])
        assert module is None or module in imported[k], (k, imported.get(k))


def test_bounds(spark, tmp_path):
    write(tmp_path, {"big.py": "x = 1\n" * 1000, "a/b/c/deep.py": "x = 1\n", "node_modules/m.js": "f()", "bin.py": b"a\0b", "bad.py": b"\xff\xfe"})
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "link.py").symlink_to(tmp_path / "big.py")
    found = {r.path: (r.status, r.reason) for r in extract.classified(scan(spark, tmp_path, maxBytes=1000, maxDepth=3)).collect()}
    assert found["big.py"] == ("skipped", "file_too_large: 6000 > 1000")
    assert found["link.py"] == ("skipped", "symlink")
    assert found["bin.py"] == ("skipped", "binary")
    assert found["bad.py"] == ("unparsed", "utf8_decode_error")
    assert not any(p.startswith(("a/b/c", "node_modules", "loop/")) for p in found)
    capped = scan(spark, tmp_path, maxFiles=1).where("reason = 'max_files_reached'")
    assert capped.count() >= 2


def test_file_cap_counts_sources(spark, tmp_path):
    noise = {f"a/{k}{end}": "x" * 2000 for k in range(10) for end in (".md", ".png", "")}
    write(tmp_path, {**noise, "a/big.py": "x = 1\n" * 1000, "b/one.py": "x = 1\n", "b/two.js": "f()\n", "b/z.py": "x = 1\n"})
    (tmp_path / "a/link.py").symlink_to(tmp_path / "b/one.py")
    found = {r.path: r.reason for r in scan(spark, tmp_path, maxFiles=2, maxBytes=1000).collect()}
    assert found["b/one.py"] == found["b/two.js"] == "" and found["b/z.py"] == "max_files_reached"
    assert found["a/big.py"] == "file_too_large: 6000 > 1000" and found["a/link.py"] == "symlink"
    assert sum(r == "max_files_reached" for r in found.values()) == 1


def test_read_budget_counts_sources(spark, tmp_path):
    write(tmp_path, {"a.csv": "x" * 500, "b.py": "x = 1\n" * 10, "c.csv": "x" * 500, "d.py": "x = 1\n" * 10, "e.py": "x = 1\n" * 10, "f.py": "x = 1\n" * 10, "g.csv": "x", "bin.py": b"x" * 900})
    files = extract.classified(scan(spark, tmp_path, maxBytes=800), max_total_bytes=130)
    found = {r.path: (r.status, r.reason) for r in files.collect()}
    assert found["b.py"] == found["d.py"] == ("parsed", "") and found["e.py"] == ("skipped", "total_bytes_exceeded")
    assert "f.py" not in found and found["bin.py"] == ("skipped", "file_too_large: 900 > 800")
    assert all(found[n] == ("unsupported", "no grammar for '.csv'") for n in ("a.csv", "c.csv", "g.csv"))


def test_import_lists(spark, tmp_path):
    write(tmp_path, {"a.py": "import os, sys as system,json\nfrom x import y, z\n", "b.php": "<?php\nuse A\\B, C\\D as E;\n"})
    edges = extract.build(scan(spark, tmp_path)).edges.where("type = 'imports'").collect()
    assert {(r.path, r.dst, r.line, r.col) for r in edges} == {
        ("a.py", "external::os", 1, 7),
        ("a.py", "external::sys", 1, 11),
        ("a.py", "external::json", 1, 25),
        ("a.py", "external::x", 2, 5),
        ("b.php", "external::A\\B", 2, 4),
        ("b.php", "external::C\\D", 2, 9),
    }


def test_any_tf_file_proves_terraform(spark, tmp_path):
    found = stacks.detect(scan(spark, write(tmp_path, {"main.tf": "x", "x/y.tf": "x", ".tf": "x"}))).collect()
    assert [(r.name, r.category, r.evidence) for r in found] == [("Terraform", "infra", "main.tf")]


def test_stacks(spark, tmp_path):
    write(
        tmp_path,
        {
            "requirements.txt": "flask==3\n# no\n-r more\nsqlalchemy[asyncio]>=2\npsycopg2-binary\n",
            "web/package.json": json.dumps({"dependencies": {"react": "1"}, "devDependencies": {"jest": "1"}}),
            "go.mod": "module x\nrequire (\n\tgithub.com/gin-gonic/gin v1.9\n)\n",
            "Cargo.toml": '[package]\nname = "x"\n\n[dependencies]\naxum = "0.7"\n',
            "Gemfile": "gem 'rails'\n",
            "bad/package.json": "{",
            "terraform/main.tf": "x",
            ".github/workflows/ci.yml": "a: 1\n",
            "deep/er/than/package.json": json.dumps({"dependencies": {"vue": "1"}}),
        },
    )
    found = {(r.name, r.category): r.evidence for r in stacks.detect(scan(spark, tmp_path)).collect()}
    assert {n for n, _ in found} == {"Python", "Flask", "SQLAlchemy", "PostgreSQL client", "Node.js", "React", "Jest", "Go", "Gin", "Rust", "Axum", "Ruby", "Ruby on Rails", "Terraform", "GitHub Actions"}
    assert found[("Node.js", "runtime")] == "bad/package.json"


@pytest.mark.parametrize("content", ["", "{", "[]", '{"dependencies": 3}'])
def test_malformed_manifest(spark, tmp_path, content):
    found = stacks.detect(scan(spark, write(tmp_path, {"package.json": content}))).collect()
    assert [r.name for r in found] == ["Node.js"]
