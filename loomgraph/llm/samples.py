"""Bounded samples of labelled rows, for fitting only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import held_out


def first_ids(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` ids that are not held out, by a hash of the id."""
    ids = rows.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, label of at most ``most`` labelled documents that are not
    held out.  The ids are broadcast: ``most`` bounds them."""
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = first_ids(known, most).join(known, "doc_id")
    return docs.select("doc_id", "text").join(F.broadcast(ids.limit(most)), "doc_id")
