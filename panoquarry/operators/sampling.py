"""Review samples: the densest panoramas, and others by a seeded order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = 5


def seeded(seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("pid")))


def choose(panos: DataFrame, sample: int = 100, empty: int = 10, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """pid, n_detections, group and the columns carry of panos (pid, n_detections, ordinal): the TOP
    densest, ties by ordinal; then as many at random as sample leaves; and some without detections. Every part is a
    top-k, so no task holds more than its share and k rows."""
    with_ = panos.filter("n_detections > 0")
    top = with_.orderBy(F.desc("n_detections"), "ordinal").limit(TOP)
    out = top.select("pid", "n_detections", *carry, F.lit("top").alias("group"))
    if sample > TOP:
        rest = with_.join(F.broadcast(top.select("pid")), "pid", "left_anti")
        out = out.unionByName(rest.orderBy(seeded(seed), "pid").limit(sample - TOP).select("pid", "n_detections", *carry, F.lit("random").alias("group")))
    if empty:
        none = panos.filter("n_detections = 0").orderBy(seeded(seed), "pid").limit(empty)
        out = out.unionByName(none.select("pid", "n_detections", *carry, F.lit("empty").alias("group")))
    return out
