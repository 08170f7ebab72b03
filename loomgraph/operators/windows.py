"""Running budgets, caps and hit windows that hold at any size.

A running sum over a whole table is taken in two steps: sums of blocks of
consecutive keys, then a running sum within each block on top of the blocks
before it; only the block sums, one row each, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, order: str, value: Column, name: str = "running", block: int = 4096) -> DataFrame:
    """``df`` with the inclusive running sum of ``value`` by the integer column ``order`` (unique)."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_value", value)
    sums = blocked.groupBy("_block").agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.withColumn("_within", F.sum("_value").over(within)).join(sums, "_block")
    return out.withColumn(name, F.col("_before") + F.col("_within")).select(*df.columns, name)


def within_budget(df: DataFrame, order: str, value: Column, most: int) -> DataFrame:
    """Rows up to the first one whose running sum exceeds ``most``; that one has ``over`` true."""
    summed = running_sum(df, order, value)
    return summed.where(F.col("running") - value <= most).withColumn("over", F.col("running") > most)


def first_of(df: DataFrame, order: str, chosen: Column, most: int) -> DataFrame:
    """``df`` with ``capped``: whether ``most`` rows were chosen up to here and more come."""
    summed = running_sum(df, order, chosen.cast("bigint"))
    return summed.withColumn("capped", F.col("running") - chosen.cast("bigint") >= most).drop("running")


def sliding_hits(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """``events`` with ``hits``: how many of the same key fell in the last ``seconds``, this one included."""
    when = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("_us", when).withColumn("hits", F.count("*").over(w)).drop("_us")
