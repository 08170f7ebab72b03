"""Admission, caps, snippets, retrieval, redaction and egress."""

import io
import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import redact
from loomgraph.operators import egress, retrieve
from loomgraph.operators.engine import Engine
from loomgraph.operators.policy import QueryCaps, QueryRefused, QueryResult
from loomgraph.plans.schema import EDGES, FILES, NODES, Graph

NAMES = ["alpha_run", "beta_run", "gamma_run", "connect"]
NODE_ROWS = [(f"m.py::function:{n}@{k}", "function", n, "m.py", "python", k + 1, k + 2, "") for k, n in enumerate(NAMES)] + [("external::len", "external", "len", "", "", 0, 0, "")]
IDS = [r[0] for r in NODE_ROWS]
EDGE_ROWS = [(IDS[0], IDS[1], "calls", "m.py", 1, 4), (IDS[1], IDS[2], "calls", "m.py", 2, 4), (IDS[2], IDS[4], "references", "m.py", 3, 4)]
CONTENT = "run = 1\npassword = 'hunter2hunter2'\nx = 3\ny\n"


@pytest.fixture(scope="module")
def engine(spark):
    graph = Graph(spark.createDataFrame(NODE_ROWS, NODES), spark.createDataFrame(EDGE_ROWS, EDGES), spark.createDataFrame([("m.py", "parsed", "python", "", 9, "", 4, 0)], FILES)).persist()
    return Engine(graph, contents=spark.createDataFrame([("m.py", CONTENT)], "path string, content string"), log=io.StringIO())


def test_refusals(engine):
    for call in (lambda: engine.find_symbol(), lambda: engine.impact(" "), lambda: engine.path_between("", "x"), lambda: engine.file_summary(""), lambda: engine.call("drop", {}), lambda: engine.call("stats", {"x": 1})):
        with pytest.raises(QueryRefused):
            call()
    with pytest.raises(ValueError):
        engine.impact("connect", "up")
    with pytest.raises(ValueError):
        engine.find_symbol(kind="gadget")


def test_bulk_refusal_and_caps(engine):
    with pytest.raises(QueryRefused, match="bulk"):
        Engine(engine.graph, QueryCaps(bulk_ratio=0.05, bulk_minimum=1)).find_symbol(kind="function")
    capped = Engine(engine.graph, QueryCaps(max_nodes=2)).find_symbol(kind="function")
    assert len(capped.nodes) == 2 and capped.truncated and capped.total_matched == 4


def test_impact_clamps_and_redacts_snippets(engine):
    found = engine.impact("beta_run", "both", 99, include_snippets=True)
    assert found.notes == ["5 hops are the most, 99 were asked for"] and len(found.nodes) == 4
    assert found.redactions >= 1 and not any("hunter2" in line for lines in found.snippets.values() for line in lines)
    assert json.loads(engine.log.getvalue().splitlines()[-1])["operation"] == "impact"
    assert engine.impact("nobody").notes == ["no symbol is called 'nobody'"]


def test_path_file_and_stats(engine):
    assert [e["dst"] for e in engine.path_between("alpha_run", "gamma_run").edges] == IDS[1:3]
    assert engine.path_between("gamma_run", "alpha_run").edges == []
    assert "status=parsed language=python" in engine.file_summary("m.py").notes
    assert engine.stats()["nodes_by_kind"] == {"external": 1, "function": 4}
    assert {t["name"] for t in engine.manifest()} == {"find_symbol", "impact", "path_between", "file_summary", "stats"}


def test_retrieval(engine, spark):
    found = retrieve.retrieve(engine, "how does alpha_run connect to GAMMA_RUN?")
    assert found["terms"] == ["alpha_run", "gamma_run"]
    assert [r.operation for r in found["results"]] == ["impact", "impact", "path_between"]
    told = retrieve.answer(found)
    assert "## Code" in told and "m.py:1\n\n    run = 1" in told and redact.MARK in told and "hunter2" not in told
    bare = retrieve.retrieve(Engine(engine.graph, log=io.StringIO()), "how does alpha_run connect to GAMMA_RUN?")
    assert "## Code" not in retrieve.answer(bare) and bare["citations"] == found["citations"]
    assert all(part in told for part in ("alpha_run", "(calls)", "`beta_run`", "m.py:1")) and "m.py:1" in found["citations"]
    assert retrieve.retrieve(engine, "what calls connect?")["terms"] == ["connect"]
    assert retrieve.retrieve(engine, "what happens when it explodes")["terms"] == []
    whole = retrieve.merged(spark, found["results"], QueryCaps(max_nodes=2))
    assert len(whole.nodes) == 2 and whole.truncated and whole.total_matched == 4
    everything = retrieve.merged(spark, found["results"], QueryCaps())
    assert [n["id"] for n in everything.nodes] == sorted({n["id"] for r in found["results"] for n in r.nodes}) and len(everything.edges) == 3
    few = retrieve.pruned(spark, found["results"][1], max_nodes=2, max_external=0)
    assert len(few.nodes) == 2 and all({e["src"], e["dst"]} <= {n["id"] for n in few.nodes} for e in few.edges)


SECRETS = [
    "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10,
    "sk-" + "x1" * 12,
    "ghp_" + "A1" * 10,
    "xoxb-" + "1" * 12,
    "AIza" + "q" * 35,
    "AKIA" + "Z" * 16,
    "sk_live_" + "9" * 20,
]


@pytest.mark.parametrize("secret", SECRETS)
def test_known_shapes(secret):
    text, n = redact.redact(f"before {secret} after")
    assert secret not in text and n == 1


@pytest.mark.parametrize("line", ["password = 'opensesame99'", '"api_key": "abcdef0123"', "auth: Bearer abcdefgh12345", "postgres://me:hidden@host/db", "Authorization: Bearer abcdefgh12345"])
def test_values(spark, line):
    text, n = redact.redact(line)
    assert n >= 1 and redact.redact(text) == (text, 0)
    row = spark.createDataFrame([(line,), (None,), ("plain words",)], "t string").select(redact.redacted(F.col("t")).alias("r")).collect()
    assert (row[0].r["text"], row[0].r["count"]) == (text, n)
    assert row[1].r["text"] is None and row[2].r["text"] == "plain words"


def test_every_value_under_a_secret_key_goes():
    tree = {"token": 12345, "credentials": {"a": 1}, "password": ["hunter2"], "secret": None, "ok": {"apiKey": True, "n": 1}}
    assert redact.redact_tree(tree) == ({"token": redact.MARK, "credentials": redact.MARK, "password": redact.MARK, "secret": redact.MARK, "ok": {"apiKey": redact.MARK, "n": 1}}, 5)
    assert redact.redact_tree(redact.redact_tree(tree)[0])[1] == 0


def test_rules_claim_text_in_their_order():
    assert redact.redact("OPENAI_API_KEY=sk-proj-abcdefghijklmnop1234567890") == ("OPENAI_API_KEY=[REDACTED]", 1)
    assert redact.redact("x-auth-token: v; my_secret = `a b`") == ("x-auth-token: [REDACTED]; my_secret = [REDACTED]", 2)
    assert redact.redact("1://a:b@c +x://a:b@c") == ("1://a:b@c +x://a:[REDACTED]@c", 1)


def test_tree_and_benign_lines():
    assert redact.redact_tree({"token": "abc", "list": ["sk-" + "y2" * 12, 3]}) == ({"token": redact.MARK, "list": [redact.MARK, 3]}, 2)
    for line in ("def total(items):", "the keyboard is here", "x = y + 1", "see http://host/path"):
        assert redact.redact(line) == (line, 0)
    key = "-----BEGIN RSA PRIVATE KEY-----\nMII\n-----END RSA PRIVATE KEY-----"
    assert redact.redact(f"a\n{key}\nb") == (f"a\n{redact.MARK}\nb", 1)


def test_egress_is_planned_and_never_sent():
    node = {"id": "f", "kind": "function", "name": "f", "path": "m.py", "start_line": 1}
    result = QueryResult("ask", nodes=[node], snippets={"f": ["password = 'hunter2hunter2'"] * 200})
    plan = egress.build_plan("why?", result, egress.EgressPolicy(max_prompt_tokens=200), "model")
    assert plan.notes and plan.prompt_tokens <= 201 and "hunter2" not in json.dumps(plan.body)
    with pytest.raises(QueryRefused, match="spend"):
        egress.build_plan("why?", result, egress.EgressPolicy(max_cost=0.0), "model")
    with pytest.raises(QueryRefused, match="not enabled"):
        egress.execute(plan, egress.EgressPolicy())
