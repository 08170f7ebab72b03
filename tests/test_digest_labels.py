"""The digest of a graph, and labels without overlaps."""

import random

from loomgraph.operators import digest, labels

ROWS = [("a", 1), ("a", None), (None, 1), ("", 1), ("a1", 11), ("b", 2), ("b", 2)]
SCHEMA = "name string, n int"


def root(spark, rows, parts=1):
    found = digest.merkle_root(spark.createDataFrame(rows, SCHEMA).repartition(parts), ("name", "n")).collect()
    assert len(found) == 1
    return tuple(found[0])


def test_digest_of_any_order_and_partitioning(spark):
    many = ROWS + [(f"x{k}", k) for k in range(600)]
    assert root(spark, many) == root(spark, many[::-1], 7)
    assert root(spark, many)[0] == len(many)


def test_digest_tells_any_change(spark):
    changed = [
        ROWS[:-1],  # one copy of two
        [("a", None), ("a", None), *ROWS[2:]],  # a null
        [("a", 1), ("a", None), ("", 1), ("", 1), *ROWS[4:]],  # null and empty
        [*ROWS[:4], ("a11", 1), *ROWS[5:]],  # a letter moves to the next column
        [("a", 2), *ROWS[1:5], ("b", 1), ("b", 2)],  # two rows swap values
        [],
    ]
    found = [root(spark, rows) for rows in (ROWS, *changed)]
    assert len(set(found)) == len(found)
    assert found[-1] == (0, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")


def test_rows_of_a_digest_move_once(spark):
    plan = digest.merkle_root(spark.createDataFrame(ROWS, SCHEMA), ("name", "n"))._jdf.queryExecution().executedPlan().toString()
    # once by row; the others are of 256 groups and of one
    assert plan.count("Exchange hashpartitioning") == 3


BOX = "id string, rank int, x double, y double, w double, h double"


def walk(rows):
    """One box after the other."""
    kept = []
    for b in sorted(rows, key=lambda b: (b[1], b[0])):
        if None not in b[2:] and b[4] > 0 and b[5] > 0 and all(abs(b[2] - o[2]) * 2 >= b[4] + o[4] or abs(b[3] - o[3]) * 2 >= b[5] + o[5] for o in kept):
            kept.append(b)
    return sorted(kept)


def shown(spark, rows):
    return sorted(map(tuple, labels.without_overlaps(spark.createDataFrame(rows, BOX), "rank").collect()))


def test_labels_equal_a_walk(spark):
    r = random.Random(4)
    rows = [(f"n{k:03}", r.randrange(40), r.random() * 900, r.random() * 500, min(r.randrange(3, 45) * 7.4 + 20, 300.0), 21.0) for k in range(160)]
    assert shown(spark, rows) == walk(rows)


def test_crowds_touching_boxes_and_bad_ones(spark):
    crowd = [(f"c{k}", k, 10.0, 10.0, 30.0, 21.0) for k in range(400)]
    row = [(f"t{k}", 5, 500.0 + 30 * k, 10.0, 30.0, 21.0) for k in range(4)]
    bad = [("z", 0, None, 1.0, 5.0, 5.0), ("y", 0, 900.0, 1.0, 0.0, 5.0)]
    found = shown(spark, crowd + row + bad)
    assert found == walk(crowd + row + bad) and [b[0] for b in found] == ["c0", "t0", "t1", "t2", "t3"]
    assert shown(spark, bad) == []
