"""Answers as text: bounds and remarks."""

from loomgraph.operators import render
from loomgraph.operators.policy import QueryResult


def test_an_answer_is_cut_and_says_so():
    nodes = [{"kind": "function", "name": f"f{k}", "path": "a.py" if k else "", "start_line": k} for k in range(70)]
    edges = [{"src": f"a.py::function:f{k}@{k}", "dst": "external::g", "type": "calls", "path": "a.py", "line": k} for k in range(61)]
    snippets = {f"n{k}": ["one", "two"] for k in range(8)}
    lines = render.shown(QueryResult("impact", nodes, edges, snippets, True, 500, ["a remark"])).split("\n")
    assert lines[0] == "500 symbols" and lines[1] == "  function  f0" and lines[2].split() == ["function", "f1", "a.py:1"]
    assert lines[61:64] == ["  (10 more)", "61 edges", "  function:f0@0 -[calls]-> g  a.py:0"] and "  (1 more)" in lines
    assert sum(line == "  | one" for line in lines) == 6 and "  (2 more)" in lines
    assert lines[-2:] == ["note: a remark", "note: a cap cut this answer"]


def test_answers_without_rows():
    assert render.shown(QueryResult("find_symbol")) == "nothing found"
    assert render.shown(QueryResult("find_symbol", notes=["no symbol"])) == "note: no symbol"
