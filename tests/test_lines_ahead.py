"""Definitions over several lines, one tree with a file for each language, with exact rows."""

import pytest

import loomgraph
from loomgraph.sources import extract, lexical
from loomgraph.sources.repository import RepositorySource

FILES = {
    "a.js": "const f = (\n  a,\n  b = g(1)\n) => {\n  return a;\n};\nclass K {\n  ring(\n    x,\n    y\n  ) {\n    if (\n      x\n    ) {\n      h(x, function () {\n        return 1;\n      });\n    }\n  }\n}\n",
    "b.ts": "interface Shop {\n  ring(a: number): void;\n  sell(\n    a: number,\n    b?: string\n  ): Promise<void>;\n}\nexport function run(\n  a: number\n): void {\n  ring(a);\n}\n",
    "c.java": "public class C {\n    public static int add(\n        int a,\n        int b)\n    {\n        if (a > b) {\n            return run(new R() {\n                public void go() { }\n            });\n        }\n        return a;\n    }\n    C(int a)\n    {\n        super(a);\n    }\n}\n",
    "d.c": "typedef struct {\n  int x;\n} point_t;\ntypedef unsigned long size_of_t;\ntypedef struct node { int v; } node_t;\nstruct pair { int l; } one;\nint proto(int a,\n          int b);\nstatic int sum(int a,\n               int b)\n{\n  return a + b;\n}\n",
    "e.cs": "class E\n{\n    public async Task<int> Get(\n        int a,\n        int b)\n    {\n        while (a < b)\n        {\n            a++;\n        }\n        return a;\n    }\n    int Plain(int a)\n    {\n        return a;\n    }\n}\n",
    "f.go": "package f\n\nconst (\n\tOne = iota\n\tTwo\n)\n\ntype (\n\tPoint struct {\n\t\tX int\n\t}\n\tName string\n)\n\nfunc Add(\n\ta int,\n\tb int,\n) int {\n\treturn a + b\n}\n",
}
WANTED = {
    "a.js": {("function", "f", 1, 6), ("class", "K", 7, 20), ("method", "ring", 8, 19)},
    "b.ts": {("interface", "Shop", 1, 7), ("method", "ring", 2, 2), ("method", "sell", 3, 6), ("function", "run", 8, 12)},
    "c.java": {("class", "C", 1, 17), ("method", "add", 2, 12), ("method", "go", 8, 8), ("method", "C", 13, 16)},
    "d.c": {("class", "point_t", 3, 3), ("class", "size_of_t", 4, 4), ("class", "node", 5, 5), ("class", "node_t", 5, 5), ("class", "pair", 6, 6), ("function", "sum", 9, 13)},
    "e.cs": {("class", "E", 1, 17), ("method", "Get", 3, 12), ("method", "Plain", 13, 16)},
    "f.go": {("constant", "One", 4, 4), ("constant", "Two", 5, 5), ("class", "Point", 9, 11), ("class", "Name", 12, 12), ("function", "Add", 15, 20)},
}


@pytest.fixture(scope="module")
def nodes(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, code in FILES.items():
        (root / name).write_text(code)
    loomgraph.ship(spark)
    spark.dataSource.register(RepositorySource)
    graph = extract.build(spark.read.format("repository").option("root", str(root)).load())
    return graph.nodes.where("kind not in ('file', 'external')").collect()


@pytest.mark.parametrize("name", sorted(FILES))
def test_definitions_over_lines(nodes, name):
    found = {(n.kind, n.name, n.start_line, n.end_line) for n in nodes if n.path == name}
    assert found == WANTED[name]


def test_text_ahead_is_in_one_line_only():
    code = "f(\n" * 3000 + ")" * 3000 + "\nint g(int a,\n int b)\n{\n}\n"
    out, on = lexical.ahead(code.split("\n"), "c")
    assert sum(map(len, out)) < 3 * len(code)
    assert out[3001] == " int b) {" and on[3000:] == [False, True, True, False, False, False]
    assert lexical.ahead([], "c") == ([], []) and lexical.ahead([")", "}", ";", "("], "go") == ([""] * 4, [False, False, False, True])
