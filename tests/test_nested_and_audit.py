"""Redaction of nested values as columns, and the sink of audit records."""

import json

import pytest
from pyspark.sql import functions as F

import loomgraph
from loomgraph.functions import redact
from loomgraph.sources.audit import AuditSink, AuditWriter

JSON = [
    ('{"k": 87}', '{"k": 87}', 0),
    ('{"k":1.50,"a":[ ]}', '{"k":1.50,"a":[ ]}', 0),  # nothing found: byte for byte
    ('{"password": 5, "x": {"my_token": [1, {"b": 2}]}}', '{"password": "[REDACTED]", "x": {"my_token": "[REDACTED]"}}', 2),
    ('{"a": ["pwd=hunter22", 3]}', '{"a": ["pwd=[REDACTED]", 3]}', 1),
    (r'{"token": 1}', '{"token": "[REDACTED]"}', 1),  # an escape in a key
    (r'{"a": "pwd=hunter22"}', '{"a": "pwd=[REDACTED]"}', 1),
    ('{"auth": {"a": 1}, "auth": 2}', '{"auth": "[REDACTED]"}', 1),
    ('{"token": "[REDACTED]"}', '{"token": "[REDACTED]"}', 0),
    ("pwd=hunter22 {", "pwd=[REDACTED] {", 1),  # not JSON
    ('["token", ' + "[" * 100_000, '"[REDACTED]"', 1),
    ("", "", 0),
    (None, None, 0),
]


def test_json_texts(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(JSON)], "k int, t string")
    found = rows.select("k", redact.redacted_json(F.col("t")).alias("r")).select("k", "r.*").orderBy("k").collect()
    assert [tuple(x)[1:] for x in found] == [(text, n) for _, text, n in JSON]


def test_maps_structs_and_variants(spark):
    rows = spark.sql("""select map('token', 7, 'b', 8) as m, named_struct('api_key', array(1, 2), 'note', 'pwd=hunter22', 'none', cast(null as int)) as s,
        array('a', 'secret: hidden12') as l, parse_json('{"auth": {"x": 1}, "y": 2}') as v""")
    found = rows.select(*(redact.redacted_nested(F.col(c)).alias(c) for c in "mslv"))
    found = found.select(*(F.to_json(F.col(c)["value"]).alias(c) for c in "mslv"), *(F.col(c)["count"].alias(f"n{c}") for c in "mslv")).first()
    assert [json.loads(found[c]) for c in "mslv"] == [
        {"token": "[REDACTED]", "b": 8},
        {"api_key": "[REDACTED]", "note": "pwd=[REDACTED]", "none": None},
        ["a", "secret: [REDACTED]"],
        {"auth": "[REDACTED]", "y": 2},
    ]
    assert [found[f"n{c}"] for c in "mslv"] == [1, 2, 1, 1]


@pytest.fixture
def sink(spark):
    loomgraph.ship(spark)
    spark.dataSource.register(AuditSink)
    return lambda df, path, **options: df.write.format("audit").mode("append").options(path=str(path), **options).save()


def lines(path):
    return sorted((json.loads(x) for f in path.glob("*.json") for x in f.read_text().splitlines()), key=lambda x: x["n"])


def test_audit_appends_redacted_records_of_a_level(spark, sink, tmp_path):
    rows = spark.range(40).select(
        F.col("id").alias("n"), F.when(F.col("id") % 4 == 0, "debug").when(F.col("id") % 4 == 1, "error").alias("level"), F.struct(F.lit("x").alias("token"), F.lit("pwd=hunter22").alias("q")).alias("params")
    )
    sink(rows.repartition(5), tmp_path / "log")
    sink(rows.where("n < 8"), tmp_path / "log", level="error")
    found = lines(tmp_path / "log")
    assert [x["n"] for x in found] == sorted([k for k in range(40) if k % 4] + [1, 5])
    assert all(x["params"] == {"token": "[REDACTED]", "q": "pwd=[REDACTED]"} for x in found)
    assert [f.name for f in (tmp_path / "log").iterdir() if f.is_dir()] == []


def test_a_failed_job_leaves_nothing(spark, sink, tmp_path):
    sink(spark.range(3).select(F.col("id").alias("n")), tmp_path / "log")
    broken = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("n"))
    with pytest.raises(Exception, match="broken"):
        sink(broken, tmp_path / "log")
    assert [x["n"] for x in lines(tmp_path / "log")] == [0, 1, 2]
    assert [f.name for f in (tmp_path / "log").iterdir() if f.is_dir()] == []


def test_jobs_at_once_and_tasks_twice(tmp_path):
    from pyspark.sql import Row

    one, two = (AuditWriter(str(tmp_path / "log"), "info", False) for _ in range(2))
    first, again, other = one.write(iter([Row(n=1)])), one.write(iter([Row(n=1)])), two.write(iter([Row(n=2)]))
    assert lines(tmp_path / "log") == []
    one.commit([again, one.write(iter([Row(n=3, level="debug")])), None])
    assert first.name != again.name and lines(tmp_path / "log") == [{"n": 1}]
    two.commit([other])
    assert lines(tmp_path / "log") == [{"n": 1}, {"n": 2}]
    with pytest.raises(ValueError):
        AuditWriter("/x", "loud", False)
