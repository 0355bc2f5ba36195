"""Connected components of an edge table, without collecting anything on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panoquarry.llm.runtime import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, label: the smallest id reachable from each id that has an edge (a, b).

    Each round every id takes the smallest label around it, and then its label's label; rounds end
    when no label changes, after about the logarithm of the longest path. Labels are pre-aggregated
    before the shuffle, so an id with very many edges is no hot task; a label that very many ids have
    is one row on one side of its join, whose other side Spark splits.
    """
    both = edges.filter("a != b").select("a", "b").unionByName(edges.filter("a != b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.keep(both.distinct(), f"{name}-both")
    labels = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), f"{name}-0")
    step = 0
    while True:
        around = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(around, labels["id"] == around["a"]).select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("top"))
        step += 1
        now = scratch.keep(near.join(up, "label", "left").select("id", "old", F.least("label", "top").alias("label")), f"{name}-{step}")
        if not now.filter("old != label").take(1):
            scratch.drop(f"{name}-both", f"{name}-{step - 1}")
            return now.select("id", "label")
        labels = now.select("id", "label")
        scratch.drop(f"{name}-{step - 1}")
