"""Interval joins against plain Python, on nested, crossing and empty ranges, ties, nulls and a key with many rows."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import resolve
from loomgraph.operators.resolve import innermost, promoted_methods, resolve_calls

RANGE = "path string, lo int, hi int, id string"


def ranges(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    rows = [(r.choice("ab"), r.randrange(-50, 200), r.randrange(0, 60), f"i{k}") for k in range(n)]
    return [(p, lo, lo + size, i) for p, lo, size, i in rows]


def test_innermost_is_the_shortest_range_around(spark):
    held, r = ranges(1, 300), random.Random(2)
    points = [(r.choice("abc"), r.randrange(-60, 280)) for _ in range(200)] + [(None, 3), ("a", None), ("a", 7), ("a", 7)]
    found = innermost(spark.createDataFrame(points, "path string, at int"), spark.createDataFrame(held, RANGE), "path", F.col("at")).collect()
    assert len(found) == len(set(points))
    for p, at, enclosing in found:
        around = [(hi - lo, i) for q, lo, hi, i in held if q == p and at is not None and lo <= at < hi]
        assert enclosing == (min(around)[1] if around else None)


def test_innermost_without_ranges(spark):
    points = spark.createDataFrame([("a", 1)], "path string, at int")
    assert innermost(points, spark.createDataFrame([], RANGE), "path", F.col("at")).collect() == [("a", 1, None)]


def test_a_key_with_many_ranges_meets_few_rows(spark):
    n = 100_000
    held = spark.range(n).select(F.lit("x").alias("path"), (F.col("id") * 3).alias("lo"), (F.col("id") * 3 + 60).alias("hi"), "id")
    points = spark.range(n).select(F.lit("x").alias("path"), (F.col("id") * 3 + 1).alias("at"))
    found = innermost(points, held, "path", F.col("at")).where("enclosing between greatest(0, (at - 61) div 3) and at div 3")
    assert found.count() == n
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_methods_lie_strictly_inside_a_class(spark):
    rows = ranges(3, 300)
    functions = rows[:150] + rows[:5] + [(None, 1, 2, "n"), ("a", None, 4, "m"), ("a", 4, None, "o")]
    classes = rows[150:] + rows[:20] + [(None, 0, 9, "c"), ("a", None, 900, "d")]
    found = promoted_methods(spark.createDataFrame(functions, RANGE), spark.createDataFrame(classes, RANGE))
    inside = lambda p, lo, hi: any(q == p and a <= lo and hi <= b and (a, b) != (lo, hi) for q, a, b, _ in classes if a is not None)
    wanted = [x for x in functions if None not in x and inside(*x[:3])]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_calls_meet_names_with_few_and_many_definitions(spark, monkeypatch):
    monkeypatch.setattr(resolve, "MOST_HELD", 6, raising=False)
    r = random.Random(4)
    defs = [(r.choice("pqrst"), f"n{min(int(r.expovariate(0.3)), 9)}", f"i{r.randrange(40)}") for _ in range(90)] + [(p, "every", f"e{p}{k}") for p in "pq" for k in range(20)]
    calls = [(r.choice("pqrstu"), f"i{r.randrange(40)}", r.choice([f"n{k}" for k in range(12)] + ["every", "none"]), k, 0) for k in range(300)]
    expected = []
    for path, src, name, line, col in calls:
        known = {d for d in defs if d[1] == name}
        targets = {i for p, _, i in known if p == path} or ({i for _, _, i in known} if len(known) <= 4 else set())
        rows = [(src, i, "calls", path, line, col, 0) for i in targets if i != src]
        expected += rows if targets else [(src, f"external::{name}", "references", path, line, col, int(len(known) > 4))]
    # equal definitions count once
    made = spark.createDataFrame(defs + defs[:30], "path string, name string, id string")
    found = resolve_calls(spark.createDataFrame(calls, "path string, src string, name string, line int, col int"), made)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert {e[2] for e in expected} == {"calls", "references"} and {e[6] for e in expected} == {0, 1}


def test_calls_move_once_by_name(spark):
    calls = spark.createDataFrame([("p", "s", "n", 1, 0)], "path string, src string, name string, line int, col int")
    found = resolve_calls(calls, spark.createDataFrame([("p", "n", "i")], "path string, name string, id string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan
