"""The force simulation, against a walk of a tree of objects in plain Python."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import layout
from loomgraph.operators.layout import Forces
from loomgraph.plans.storage import shared_dir


class Cell:
    """A cube of a tree that divides until each node is alone or the cube is small."""

    def __init__(self, who, places, centre, half):
        self.half, self.mass, self.mean, self.parts = half, len(who), places[who].mean(axis=0), []
        if len(who) > 1 and half >= Forces.finest:
            side = places[who] > centre
            for corner in np.unique(side, axis=0):
                inside = who[(side == corner).all(axis=1)]
                self.parts.append(Cell(inside, places, centre + np.where(corner, half, -half) / 2, half / 2))

    def push(self, place, seed):
        apart = place - self.mean
        gap = (apart**2).sum()
        if gap < 1e-6:
            return np.array([seed % 7 - 3, seed % 5 - 2, seed % 3 - 1]) * 0.4
        gap = max(gap, 36.0)
        if not self.parts or 2 * self.half / math.sqrt(gap) < 0.9:
            return apart * 220.0 * self.mass / gap
        return sum(p.push(place, seed) for p in self.parts)


def plain(places, velocities, seeds, edges, ticks):
    degree = np.bincount(np.array(edges).ravel(), minlength=len(places)) if edges else None
    heat = 1.0
    for _ in range(ticks):
        half = max(1.0, np.abs(places).max()) + 10
        tree = Cell(np.arange(len(places)), places, np.zeros(3), half)
        change = np.array([tree.push(p, s) for p, s in zip(places, seeds)]) * heat
        for a, b in edges:
            gap = places[b] - places[a]
            length = math.sqrt((gap**2).sum()) or 0.01
            pull = gap * (length - 42) / length * heat * 0.5 / min(degree[a], degree[b])
            change[a] += pull
            change[b] -= pull
        velocities = (velocities + change - places * 0.012 * heat) * 0.6
        speed = np.linalg.norm(velocities, axis=1)
        velocities = velocities * np.where(speed > 30, 30 / np.maximum(speed, 30), 1.0)[:, None]
        places = places + velocities
        out = np.abs(places) > 20000
        places, velocities = np.clip(places, -20000, 20000), np.where(out, 0.0, velocities)
        heat += (0.001 - heat) * 0.0228
    return places, velocities


def run(spark, places, seeds, edges, ticks):
    rows = [(f"n{k}", *map(float, p), s) for k, (p, s) in enumerate(zip(places, seeds))]
    at = layout.at_rest(spark.createDataFrame(rows, "id string, x double, y double, z double, s int"), F.col("s"))
    links = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "src string, dst string")
    found = {r.id: r for r in layout.simulate(at, links, ticks).collect()}
    assert len(found) == len(places)
    order = [found[f"n{k}"] for k in range(len(places))]
    return np.array([(r.x, r.y, r.z) for r in order]), np.array([(r.vx, r.vy, r.vz) for r in order])


@pytest.mark.parametrize(("scale", "ticks"), [(90.0, 3), (4.0, 2), (12000.0, 1)])
def test_ticks_equal_a_tree_of_objects(spark, scale, ticks):
    rng = np.random.default_rng(int(scale))
    places = rng.normal(scale=scale, size=(200, 3))
    places[1] = places[0]  # two on one place
    places[2] = np.sign(places[2]) * 19999.5 if scale > 1000 else places[2]
    seeds = rng.integers(1, 1000, 200).tolist()
    edges = [tuple(map(int, e)) for e in rng.integers(0, 200, (260, 2))] + [(0, int(k)) for k in rng.integers(0, 200, 90)] + [(5, 5), (6, 7), (6, 7)]
    got = run(spark, places, seeds, edges, ticks)
    expected = plain(places, np.zeros((200, 3)), seeds, edges, ticks)
    for g, e in zip(got, expected):
        np.testing.assert_allclose(g, e, rtol=1e-7, atol=1e-7)


def test_octree_counts_each_node_once_a_level(spark):
    places = np.random.default_rng(3).normal(scale=900.0, size=(300, 3))
    places[0], places[1] = (8000, -8000, 3), 0.0
    at = layout.at_rest(spark.createDataFrame([(str(k), *map(float, p)) for k, p in enumerate(places)], "id string, x double, y double, z double"))
    tree = layout.octree(at, 8010.0, 14)
    assert {r.n for r in tree.groupBy("level").agg(F.sum("m").alias("n")).collect()} == {300}
    inner = tree.alias("c").join(tree.alias("p"), F.expr("c.level = p.level + 1 and c.up = p.cell"))
    assert inner.groupBy("p.level", "p.cell", "p.m").agg(F.sum("c.m").alias("n")).where("n != m").count() == 0
    assert inner.count() == tree.where("level > 0").count()


def test_springs_are_weak_between_hubs(spark):
    edges = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", None)]
    found = {(r.src, r.dst): r.weight for r in layout.springs(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert found == {("a", "b"): pytest.approx(2 / 3), ("a", "c"): 1.0, ("b", "d"): 1.0}


def test_odd_states_and_deleted_tables(spark):
    schema = "id string, x double, y double, z double"
    none = spark.createDataFrame([], schema)
    edges = spark.createDataFrame([("a", "gone")], "src string, dst string")
    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    assert layout.simulate(layout.at_rest(none), edges, 2).count() == 0
    odd = spark.createDataFrame([("a", None, float("nan"), 1.0)], schema)
    alone = layout.simulate(layout.at_rest(odd, F.lit(10)), edges, 1).collect()
    # alone: its own jitter, (10 % 7 - 3, 10 % 5 - 2, 10 % 3 - 1) * 0.4, and the centre
    assert [tuple(r)[1:4] for r in alone] == [pytest.approx((0.0, -0.8 * 0.6, 1.0 - 0.012 * 0.6))]
    # of all tables only the last state of each call is left
    assert sorted(name.split("-")[0] for name in set(os.listdir(folder)) - before) == ["state", "state"]


def test_a_tick_stores_no_pairs_of_nodes_and_cells(spark, monkeypatch):
    stored, stash, n = [], layout.stash, 4000
    monkeypatch.setattr(layout, "stash", lambda df, label: stored.append(stash(df, label)) or stored[-1])
    counted = []
    monkeypatch.setattr(layout, "drop_stash", lambda *tables: counted.extend(t.count() for t in tables))
    monkeypatch.setattr(layout, "PART_NODES", 40, raising=False)
    rng = np.random.default_rng(9)
    places = rng.normal(scale=10.0, size=(n, 3))
    places[:500] = places[0]  # very many on one place, dealt to parts
    got = run(spark, places, rng.integers(1, 1000, n).tolist(), [], 1)
    assert len(got[0]) == n and np.ptp(got[0][:500], axis=0).max() < 10
    # each node meets over a hundred cells
    assert sum(counted) < 40 * n
