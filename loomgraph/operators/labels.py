"""Which labels of a drawing are shown: a greedy choice of boxes that do not overlap, in parallel rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.storage import drop_stash, stash

# Width of a letter, of the margins, and of a label at most; height of a label.
LETTER, MARGIN, WIDEST, HEIGHT = 7.4, 20.0, 300.0, 21.0


def label_box(name: Column, x: Column, y: Column) -> Column:
    """struct<x, y, w, h> around a centre."""
    width = F.least(F.length(name) * F.lit(LETTER) + MARGIN, F.lit(WIDEST))
    return F.struct(x.alias("x"), y.alias("y"), width.alias("w"), F.lit(HEIGHT).alias("h"))


def without_overlaps(boxes: DataFrame, *order: str) -> DataFrame:
    """Boxes (id, x, y, w, h: centre and size, ...) that a walk by ``order``, then
    id, keeps that leaves out what overlaps a kept box.  Touching is no overlap.

    Boxes are dealt to grid cells no larger than the smallest box.  In a round
    the first open box of all its cells is kept, and open boxes that overlap a
    kept one close.  At most four boxes without overlaps meet in a cell, so no
    round pairs more than that with a box, however many crowd a cell.  There are as
    many rounds as boxes wait for each other in a row.  Boxes with a null or
    without a size are left out; ids are distinct."""
    sides = boxes.where("x is not null and y is not null and w > 0 and h > 0")
    least = sides.agg(F.min("w"), F.min("h")).first()
    if least[0] is None:
        return sides
    columns, cells = boxes.columns, []
    for at, size, step in (("x", "w", least[0]), ("y", "h", least[1])):
        edge = lambda sign, at=at, size=size, step=step: F.floor((F.col(at) + sign * F.col(size) / 2) / step)
        cells.append(F.sequence(edge(-1), edge(1)))
    first = F.struct(*order, "id")
    stays = stash(sides.select(*columns, first.alias("_first")), "boxes")
    dealt = lambda rows: rows.withColumn("_cx", F.explode(cells[0])).withColumn("_cy", F.explode(cells[1]))
    open_, kept = stays, []
    while not open_.isEmpty():
        leads = dealt(open_).groupBy("_cx", "_cy").agg(F.min("_first").alias("_lead"))
        ours = dealt(open_.select("id", "x", "y", "w", "h", "_first")).join(leads, ["_cx", "_cy"])
        chosen = ours.groupBy("id").agg(F.bool_and(F.col("_first") == F.col("_lead")).alias("_leads")).where("_leads").select("id")
        kept.append(stash(open_.join(chosen, "id", "left_semi"), "kept"))
        taken = dealt(kept[-1].select(*(F.col(c).alias(f"_{c}") for c in ("id", "x", "y", "w", "h")), "x", "y", "w", "h")).select("_cx", "_cy", "_id", "_x", "_y", "_w", "_h")
        met = (F.abs(F.col("x") - F.col("_x")) * 2 < F.col("w") + F.col("_w")) & (F.abs(F.col("y") - F.col("_y")) * 2 < F.col("h") + F.col("_h"))
        closed = dealt(open_.select("id", "x", "y", "w", "h")).join(taken, ["_cx", "_cy"]).where(met).select("id").distinct()
        left = stash(open_.join(closed, "id", "left_anti"), "open")
        drop_stash(open_)
        open_ = left
    drop_stash(open_)
    out = kept[0]
    for more in kept[1:]:
        out = out.union(more)
    return out.select(*columns)
