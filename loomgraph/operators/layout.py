"""Layout of a graph in space: seeded start places, and a force simulation whose state is a table.

A tick sorts the nodes into cells of an octree, level by level (the level is a
shift of the cell's key), and walks the tree from its root: a cell is taken as
one body where it is a leaf or looks small from the node, or else its children
are met.  Nodes near each other walk together: a group (the nodes of a few
cells) meets the children of each cell that may be open to any place in its box,
by an equi-join on the cell.  Then the nodes of a group, in bounded parts, meet
these cells in a task, where each node decides by itself which of them are
bodies.  So a node meets some hundred cells, whatever the number of nodes; pairs
of nodes and cells are neither stored nor moved, and no step pairs nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.storage import drop_stash, stash

# The linear congruential generator of the start positions.
FACTOR, ADDEND, MODULUS = 1664525, 1013904223, 1 << 32

AXES = ("x", "y", "z")
STATE = ("id", *AXES, "vx", "vy", "vz", "seed")
#: Bits of a cell's key for each axis; a cell's parent has one less of them in use.
_BITS = 20
#: Cells of one level that are broadcast at most; level l has no more than 8 ** l.
BROADCAST_CELLS = 1 << 15
#: Lowest cells of a group at most, and nodes of a group that a task holds at once, or so.
GROUP_SEATS, PART_NODES = 64, 4096
#: Numbers in a matrix of nodes and cells at most, but for one node.
_MATRIX = 1 << 17


@dataclass(frozen=True)
class Forces:
    """The constants of the simulation (fixed values)."""

    repulsion: float = 220.0
    #: a cell is one body where its side is below so many times its distance
    opening: float = 0.9
    #: squared distance below which no body repels more strongly
    least_gap: float = 36.0
    #: cells of less than this half side are not divided
    finest: float = 0.5
    rest_length: float = 42.0
    centring: float = 0.012
    #: share of its velocity that a node keeps
    kept: float = 0.6
    fastest: float = 30.0
    farthest: float = 20000.0
    #: the heat of the first tick, where it tends to and how fast
    heat: float = 1.0
    coolest: float = 0.001
    cooling: float = 0.0228

    def heats(self) -> Iterator[float]:
        heat = self.heat
        while True:
            yield heat
            heat += (self.coolest - heat) * self.cooling


def lcg(seed: Column) -> Column:
    """The next number of the generator; stays within 64 bits."""
    return F.pmod(seed * FACTOR + ADDEND, F.lit(MODULUS))


def start(nodes: DataFrame, seed: Column, extent: float = 100.0, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(id, x, y, z): three generator steps from each node's own seed, scaled to [-extent, extent]; ``keep`` names the other columns."""
    steps = nodes.select(*keep, lcg(F.pmod(seed, F.lit(MODULUS))).alias("a")).withColumn("b", lcg(F.col("a"))).withColumn("c", lcg(F.col("b")))
    scale = lambda c: (F.col(c) / F.lit(float(MODULUS)) * 2 - 1) * extent
    return steps.select(*keep, scale("a").alias("x"), scale("b").alias("y"), scale("c").alias("z"))


def at_rest(places: DataFrame, seed: Column | None = None) -> DataFrame:
    """A state without velocities; places that are null or NaN count as 0.

    ``seed`` (from 1 on, say) decides where a node goes that lies on another's place."""
    place = [F.coalesce(F.nanvl(F.col(a).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(a) for a in AXES]
    zero = [F.lit(0.0).alias(f"v{a}") for a in AXES]
    return places.select("id", *place, *zero, (F.lit(0) if seed is None else seed).cast("bigint").alias("seed"))


def springs(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): all edges of a pair as one, weaker between two hubs.

    An edge counts one over the smaller degree of its ends, so that a hub's
    leaves follow it, and two hubs do not pull each other in."""
    pairs = edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id"), "n").groupBy("id").agg(F.sum("n").alias("degree"))
    for end in ("src", "dst"):
        pairs = pairs.join(ends.select(F.col("id").alias(end), F.col("degree").alias(f"{end}_degree")), end)
    return pairs.select("src", "dst", (F.col("n") / F.least("src_degree", "dst_degree")).alias("weight"))


def _mask(shift: int) -> int:
    """What is left of a key when each axis has lost its last ``shift`` bits."""
    field = (1 << (_BITS - shift)) - 1
    return field << 2 * _BITS | field << _BITS | field


def _seat(half: float, levels: int) -> Column:
    """The key of the lowest cell around a place; one on a border belongs to the lower cell."""
    side = 2 * half / (1 << levels)
    key = F.lit(0).cast("bigint")
    for a in AXES:
        key = F.shiftleft(key, _BITS).bitwiseOR(F.greatest(F.ceil((F.col(a) + half) / side) - 1, F.lit(0)).cast("bigint"))
    return key


def _around(seats: DataFrame, levels: int) -> DataFrame:
    """``seats`` with each ``level`` and the ``cell`` of that level around the column ``seat``."""
    shifts = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(levels - k).alias("shift"), F.lit(_mask(levels - k)).alias("mask")) for k in range(levels + 1)))
    return seats.select("*", F.inline(shifts)).withColumn("cell", F.expr("shiftright(seat, shift) & mask")).drop("shift", "mask")


def octree(state: DataFrame, half: float, levels: int) -> DataFrame:
    """level, cell, up (the cell around it), m (nodes), and the mean place mx, my, mz of each cell that holds nodes."""
    fine = state.groupBy(_seat(half, levels).alias("seat")).agg(F.count("*").alias("m"), *(F.sum(a).alias(f"s{a}") for a in AXES))
    sums = _around(fine, levels).groupBy("level", "cell").agg(*(F.sum(c).alias(c) for c in ("m", "sx", "sy", "sz")))
    up = F.shiftright("cell", 1).bitwiseAND(F.lit(_mask(1)))
    return sums.select("level", "cell", up.alias("up"), "m", *((F.col(f"s{a}") / F.col("m")).alias(f"m{a}") for a in AXES))


def grouped(cells: DataFrame, half: float, levels: int) -> DataFrame:
    """seat (each lowest cell), its group (``top``, ``group``: level and key of the highest
    cell around it of ``GROUP_SEATS`` lowest cells at most) and the group's ``nodes``."""
    tall = _around(cells.where(F.col("level") == levels).select(F.col("cell").alias("seat"), "m"), levels)
    fit = tall.groupBy("level", "cell").agg(F.count("*").alias("seats"), F.sum("m").alias("nodes")).where(F.col("seats") <= GROUP_SEATS)
    best = tall.join(fit, ["level", "cell"]).groupBy("seat").agg(F.min(F.struct("level", "cell", "nodes")).alias("g"))
    return best.select("seat", F.col("g.level").alias("top"), F.col("g.cell").alias("group"), F.col("g.nodes").alias("nodes"))


def _boxes(groups: DataFrame, half: float, levels: int) -> DataFrame:
    """top, group, nodes and the box (lx, hx, ...) around the lowest cells of each group, a hair wider."""
    side, hair = 2 * half / (1 << levels), 1e-9 * half
    index = {a: F.shiftright("seat", 2 * _BITS - k * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1)) for k, a in enumerate(AXES)}
    low = [(F.min(c) * side - half - hair).alias(f"l{a}") for a, c in index.items()]
    high = [((F.max(c) + 1) * side - half + hair).alias(f"h{a}") for a, c in index.items()]
    return groups.groupBy("top", "group").agg(F.max("nodes").alias("nodes"), *low, *high)


def _met(boxes: DataFrame, level: int, levels: int, half: float, forces: Forces) -> DataFrame:
    """Groups and cells that they meet: whether the cell may be ``open`` to a place in the box."""
    out = [F.greatest(F.col(f"l{a}") - F.col(f"m{a}"), F.col(f"m{a}") - F.col(f"h{a}"), F.lit(0.0)) for a in AXES]
    least = F.sqrt(F.greatest(sum(c**2 for c in out), F.lit(forces.least_gap)))
    small = F.lit(2 * half / (1 << level)) / least < forces.opening
    return boxes.withColumn("level", F.lit(level)).withColumn("open", F.lit(level < levels) & (F.col("m") > 1) & ~small)


def _pushes(levels: int, half: float, forces: Forces):
    """The state of nodes with their pushes, from the cells that their group meets; each node
    takes a cell as one body, or opens it and so reaches the children, by itself."""

    def run(nodes: pa.Table, cells: pa.Table) -> pa.Table:
        places = np.stack([nodes[a].to_numpy() for a in AXES])
        level, key, m = (cells[c].to_numpy() for c in ("level", "cell", "m"))
        order = np.lexsort((key, level))
        level, key, m = level[order], key[order], m[order]
        means = np.stack([cells[f"m{a}"].to_numpy()[order] for a in AXES])
        ends = np.searchsorted(level, np.arange(level.max(initial=-1) + 2))
        force, same = np.zeros_like(places), np.zeros(places.shape[1], np.int64)
        step = max(1, _MATRIX // max(1, int(np.diff(ends).max(initial=1))))
        for first in range(0, places.shape[1], step):
            here = slice(first, first + step)
            opened = before = None
            for k, (low, high) in enumerate(zip(ends, ends[1:])):
                apart = places[:, here, None] - means[:, None, low:high]
                gap = (apart**2).sum(axis=0)
                equal = gap < 1e-6
                far = np.maximum(gap, forces.least_gap)
                body = equal | (m[low:high] == 1) | (k == levels) | (2 * half / (1 << k) / np.sqrt(far) < forces.opening)
                reached = np.ones_like(body) if before is None else opened[:, np.searchsorted(before, key[low:high] >> 1 & _mask(1))]
                taken = reached & body
                force[:, here] += np.einsum("anc,nc->an", apart, np.where(taken & ~equal, forces.repulsion * m[low:high] / far, 0.0))
                same[here] += (taken & equal).sum(axis=1)
                opened, before = reached & ~body, key[low:high]
        columns = {c: nodes[c] for c in STATE} | {f"f{a}": pa.array(f) for a, f in zip(AXES, force)} | {"same": pa.array(same)}
        return pa.table(columns)

    return run


def repelled(state: DataFrame, forces: Forces, held: list[DataFrame]) -> DataFrame:
    """The state with fx, fy, fz (the push of all other nodes on each) and same (how many
    cells lie on its own place).  Tables that it stashes go to ``held``."""
    extent = state.agg(F.max(F.greatest(*(F.abs(a) for a in AXES)))).first()[0]
    if extent is None:
        return state.select("*", *(F.lit(0.0).alias(f"f{a}") for a in AXES), F.lit(0).alias("same"))
    half = max(1.0, extent) + 10.0
    finest = next(k for k in range(_BITS) if half / (1 << k) < forces.finest)
    # a cell that looks small from the least distance is never open, so none is needed below it
    levels = next(k for k in range(_BITS) if k == finest or 2 * half / (1 << k) / sqrt(forces.least_gap) < forces.opening)
    # ordered by level, so that a read of one level skips the others
    cells = stash(octree(state, half, levels).sortWithinPartitions("level"), "cells")
    groups = stash(grouped(cells, half, levels), "groups")
    held += [cells, groups]
    boxes = _boxes(groups, half, levels)
    met = [_met(boxes.crossJoin(F.broadcast(cells.where("level = 0").drop("level", "up"))), 0, levels, half, forces)]
    for level in range(1, levels + 1):
        children = cells.where(F.col("level") == level).drop("level")
        if 8**level <= BROADCAST_CELLS:
            children = F.broadcast(children)
        above = met[-1].where("open").drop("level", "m", "mx", "my", "mz", "open").withColumnRenamed("cell", "up")
        met.append(stash(_met(above.join(children, "up").drop("up"), level, levels, half, forces), "met"))
        held.append(met[-1])
        if met[-1].where("open").isEmpty():
            break
    every = met[0]
    for more in met[1:]:
        every = every.unionByName(more)
    parts = F.ceil(F.col("nodes") / PART_NODES)
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part_of")
    dealt = every.select(F.col("top").alias("top_of"), F.col("group").alias("group_of"), part, "level", "cell", "m", "mx", "my", "mz")
    seated = state.withColumn("seat", _seat(half, levels)).join(groups, "seat").withColumn("part", F.pmod(F.xxhash64("id"), parts)).drop("seat", "nodes")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.select(*STATE).schema) + ", fx double, fy double, fz double, same bigint"
    return seated.groupBy("top", "group", "part").cogroup(dealt.groupBy("top_of", "group_of", "part_of")).applyInArrow(_pushes(levels, half, forces), schema)


def _pulled(state: DataFrame, links: DataFrame, heat: float, forces: Forces) -> DataFrame:
    """(id, px, py, pz): the change of velocity by springs, equal and opposite at their ends."""
    ends = links
    for end, mark in (("src", "a"), ("dst", "b")):
        ends = ends.join(state.select(F.col("id").alias(end), *(F.col(a).alias(f"{mark}{a}") for a in AXES)), end)
    length = F.sqrt(sum((F.col(f"b{a}") - F.col(f"a{a}")) ** 2 for a in AXES))
    share = F.when(length == 0, 0.0).otherwise((length - forces.rest_length) / length) * (heat * 0.5) * F.col("weight")
    pull = [share * (F.col(f"b{a}") - F.col(f"a{a}")) for a in AXES]
    both = F.array(F.struct(F.col("src").alias("id"), *(p.alias(f"p{a}") for p, a in zip(pull, AXES))), F.struct(F.col("dst").alias("id"), *((-p).alias(f"p{a}") for p, a in zip(pull, AXES))))
    return ends.select(F.inline(both)).groupBy("id").agg(*(F.sum(f"p{a}").alias(f"p{a}") for a in AXES))


def tick(state: DataFrame, links: DataFrame, heat: float, forces: Forces, held: list[DataFrame]) -> DataFrame:
    """The state after one tick: repulsion, springs and a weak pull to the centre change the
    velocity, which then decays and is bounded, and moves the node."""
    joined = repelled(state, forces, held).join(_pulled(state, links, heat, forces), "id", "left")
    # moves nodes apart that lie on one place
    jitter = {a: (F.pmod(F.col("seed"), F.lit(n)) - n // 2) * 0.4 for a, n in zip(AXES, (7, 5, 3))}
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    speed = {a: (F.col(f"v{a}") + heat * (zero(f"f{a}") + zero("same") * jitter[a] - forces.centring * F.col(a)) + zero(f"p{a}")) * forces.kept for a in AXES}
    moved = joined.select("id", "seed", *AXES, *(speed[a].alias(f"v{a}") for a in AXES)).withColumn("speed", F.sqrt(sum(F.col(f"v{a}") ** 2 for a in AXES)))
    bound = F.when(F.col("speed") > forces.fastest, forces.fastest / F.col("speed")).otherwise(1.0)
    moved = moved.select("id", "seed", *AXES, *((F.col(f"v{a}") * bound).alias(f"v{a}") for a in AXES))
    place = {a: F.col(a) + F.col(f"v{a}") for a in AXES}
    inside = lambda c: F.greatest(F.lit(-forces.farthest), F.least(F.lit(forces.farthest), c))
    out = [F.when(F.abs(place[a]) > forces.farthest, 0.0).otherwise(F.col(f"v{a}")).alias(f"v{a}") for a in AXES]
    return moved.select("id", *(inside(place[a]).alias(a) for a in AXES), *out, "seed")


def simulate(state: DataFrame, edges: DataFrame, ticks: int, forces: Forces = Forces()) -> DataFrame:
    """The state (``at_rest``, or what a call before returned) after so many ticks.

    Each tick's state is a table of the shared folder; what a tick made is
    deleted once the next state is written.  Ids are unique; edges whose ends
    are not both there do nothing; an empty state stays empty."""
    links = stash(springs(edges), "springs")
    now = stash(state.select(*STATE), "state")
    for _, heat in zip(range(ticks), forces.heats()):
        held: list[DataFrame] = []
        after = stash(tick(now, links, heat, forces, held), "state")
        drop_stash(now, *held)
        now = after
    drop_stash(links)
    return now
