"""The limiter and the stream jobs."""

import random
from collections import defaultdict

import pytest

from loomgraph.streaming import rate_limit, scan


def brute(rows, most, seconds):
    taken, out = defaultdict(list), {}
    for key, at, event in sorted(rows):
        recent = [t for t in taken[key] if t > at - seconds * 1_000_000]
        out[event] = len(recent) < most
        if out[event]:
            taken[key].append(at)
    return out


def test_exact_limit(spark):
    r = random.Random(5)
    rows = [(r.randrange(3), r.randrange(200) * 1_000_000, k) for k in range(400)]
    got = rate_limit.limited(spark.createDataFrame(rows, "key long, at long, event_id long"), most=4, seconds=20).collect()
    assert {x.event_id: x.accepted for x in got} == brute(rows, 4, 20)


@pytest.mark.parametrize("late", [None, "5 seconds"])
def test_limit_on_a_stream_of_three_batches(spark, tmp_path, late):
    r = random.Random(6)
    day = 1_700_000_000  # Spark's first watermark is the start of 1970, and what is not after it is late
    rows = [(r.randrange(3), (day + 100 * k + r.randrange(90)) * 1_000_000, 1000 * k + n) for k in range(3) for n in range(60)]
    rows += [(7, (day + 5) * 1_000_000, 9001), (7, (day + 201) * 1_000_000, 9002)]
    schema = "key long, at long, event_id long"
    for k in range(3):
        spark.createDataFrame([x for x in rows if x[1] // 1_000_000 - day in range(100 * k, 100 * k + 100)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = rate_limit.limited_stream(stream, most=4, seconds=30, late=late)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 3
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {x.event_id: x.accepted for x in found} == brute(rows, 4, 30) and len(found) == len(rows)
    if late:
        # key 7 fell silent after its first hit, and was forgotten before its second
        assert sum(p["stateOperators"][0]["numRowsRemoved"] for p in query.recentProgress if p["stateOperators"]) > 0


def test_stage_windows_and_write(spark, tmp_path):
    rows = [(k, f"2024-01-01 0{k % 3}:10:00", k, "build" if k % 2 else "query", 1.0) for k in range(12)]
    spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = scan.stage_windows(scan.arriving(spark, str(tmp_path / "in"), scan.HITS))
    query = stream.writeStream.format("memory").queryName("stages").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.stage, r.runs) for r in spark.table("stages").collect()} == {("build", 2), ("query", 2)}
    scan.write(scan.arriving(spark, str(tmp_path / "in"), scan.HITS), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
