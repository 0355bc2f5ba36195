"""Entries of a review gallery, which of them a viewer shows, and the export of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panoquarry.functions import pixels

CROP = 512


def crops(pid: Column, detections: Column, width: Column, height: Column, crop: int = CROP) -> Column:
    """For each detection its close-up: where it starts, its file's name, the detection's place in
    the panorama and in the crop. width and height are those of the image that is cut."""
    start = lambda p, size: F.least(F.greatest(p - crop / 2, F.lit(0.0)), (size - crop).cast("double")).cast("int")

    def one(d: Column, i: Column) -> Column:
        px, py = d["x_normalized"] * width, d["y_normalized"] * height
        left, top = start(px, width), start(py, height)
        return F.struct(
            F.concat(pid, F.lit("_det"), i.cast("string"), F.lit(".jpg")).alias("img"), F.round(d["confidence"], 4).alias("conf"), F.round(d["x_normalized"], 5).alias("x"), F.round(d["y_normalized"], 5).alias("y"),
            pixels.in_crop(px, left, crop).alias("cx"), pixels.in_crop(py, top, crop).alias("cy"), left.alias("left"), top.alias("top"),
        )

    return F.transform(detections, one)


def entries(chosen: DataFrame) -> DataFrame:
    """pid, date, group, full, crops of chosen (pid, date, group, detections, width, height), those
    with most crops first."""
    made = crops(F.col("pid"), F.col("detections"), F.col("width"), F.col("height"))
    return chosen.select("pid", "date", "group", F.concat("pid", F.lit("_full.jpg")).alias("full"), made.alias("crops")).orderBy(F.desc(F.size("crops")), "pid")


def is_reviewed(n: Column) -> Column:
    """Whether a state (seen, dets, missed, no_missed) is complete for n detections. Unlike in
    scoring, a state without no_missed is not trusted."""
    checked = (F.size("missed") > 0) | F.coalesce("no_missed", F.lit(False))
    return F.coalesce(F.col("seen") & checked & (F.size("dets") == n) & ~F.exists("dets", lambda d: d.isNull()), F.lit(False))


def shown(states: DataFrame, mode: str) -> DataFrame:
    """The rows of states (pid, n, and a state or nulls) that the viewer shows in a mode."""
    return states.filter({"all": F.lit(True), "det": F.col("n") > 0, "empty": F.col("n") == 0, "todo": ~is_reviewed(F.col("n"))}[mode])


def progress(states: DataFrame) -> DataFrame:
    """One row: reviewed, entries, and the certain and unsure marks."""
    marks = lambda flag: F.coalesce(F.sum(F.size(F.filter("missed", lambda m: F.coalesce(m["unsure"], F.lit(False)) == F.lit(flag)))), F.lit(0))
    return states.agg(F.count_if(is_reviewed(F.col("n"))).alias("reviewed"), F.count("*").alias("entries"), marks(False).alias("sure"), marks(True).alias("unsure"))


def export(entries: DataFrame, states: DataFrame) -> DataFrame:
    """pid and its verdict (group, dets, missed, no_missed) of entries that were seen."""
    df = entries.select("pid", "group").join(states.filter("seen").select("pid", "dets", "missed", "no_missed"), "pid")
    return df.select("pid", F.struct("group", "dets", "missed", F.coalesce("no_missed", F.lit(False)).alias("no_missed")).alias("verdict"))
