"""Bounded samples for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(rows: DataFrame, size: Column, most: int) -> DataFrame:
    """Of a written table of some thousand documents (doc_id, each once) those whose sizes, in the order of a hash of
    their ids, sum to ``most`` at most."""
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.select("doc_id", size.alias("size")).withColumn("running", F.sum("size").over(order)).where(F.col("running") <= most)
    return rows.join(F.broadcast(kept.select("doc_id")), "doc_id", "left_semi")
