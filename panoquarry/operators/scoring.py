"""Human verdicts joined to detections: precision and recall with intervals, and a threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panoquarry.functions.pixels import wilson

#: The thresholds of the sweep.
THRESHOLDS = (0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)


def matched(entries: DataFrame, confs: DataFrame) -> DataFrame:
    """entries (pid, group, dets, missed, no_missed) with confs and ``fits``: whether there is one
    confidence for each verdict."""
    return entries.join(confs.select("pid", "confs"), "pid", "left").withColumn("fits", F.coalesce(F.size("confs") == F.size("dets"), F.lit(False)))


def reviewed(entries: DataFrame, confs: DataFrame, exclude_top: bool = False, assume_scanned: bool = False) -> DataFrame:
    """One row for each entry that counts: pid, dets, confs, missed, judged (no verdict open) and
    checked (its missed marks are complete). An entry without no_missed is of the old kind, trusted."""
    df = matched(entries, confs).filter("fits").withColumn("missed", F.coalesce("missed", F.array().cast("array<struct<x:double,y:double,unsure:boolean>>")))
    if exclude_top:
        df = df.filter(~F.col("group").eqNullSafe(F.lit("top")))
    done = F.when(F.col("no_missed").isNull(), True).otherwise(F.col("no_missed") | (F.size("missed") > 0))
    return df.withColumn("judged", ~F.exists("dets", lambda d: d.isNull())).withColumn("checked", F.col("judged") & (F.lit(True) if assume_scanned else done))


def pool(seen: DataFrame, which: str = "judged") -> DataFrame:
    """pid, idx, conf, ok of the decided detections; which: judged or checked."""
    parts = seen.filter(which).select("pid", F.posexplode(F.arrays_zip("confs", "dets")).alias("idx", "d"))
    return parts.filter(F.col("d.dets") != "unsure").select("pid", (F.col("idx") + 1).cast("long").alias("idx"), F.col("d.confs").alias("conf"), (F.col("d.dets") == "true").alias("ok"))


def _count(condition: Column, verdict: str) -> Column:
    return F.sum(F.when(condition, F.size(F.filter("dets", lambda d: d == verdict))).otherwise(0)).cast("long")


def _marks(unsure: bool) -> Column:
    flag = lambda m: F.coalesce(m["unsure"], F.lit(False)) == F.lit(unsure)
    return F.sum(F.when(F.col("checked"), F.size(F.filter("missed", flag))).otherwise(0)).cast("long")


def summary(seen: DataFrame) -> DataFrame:
    """One row of counts, precision, recall and their intervals, in one pass over the entries."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    df = seen.agg(
        F.count("*").alias("n_seen"), n(F.col("judged")).alias("n_judged"), n(F.col("judged") & ~F.col("checked")).alias("n_unconfirmed"),
        *(F.coalesce(c, F.lit(0)).alias(k) for k, c in {
            "n_unsure": _count(F.col("judged"), "unsure"), "tp": _count(F.col("judged"), "true"), "fp": _count(F.col("judged"), "false"),
            "recall_tp": _count(F.col("checked"), "true"), "missed": _marks(False), "missed_unsure": _marks(True),
        }.items()),
    )
    decided, ramps = F.col("tp") + F.col("fp"), F.col("recall_tp") + F.col("missed")
    (p_lo, p_hi), (r_lo, r_hi) = wilson(F.col("tp"), decided), wilson(F.col("recall_tp"), ramps)
    return df.select(
        "*", F.when(decided > 0, F.col("tp") / F.when(decided > 0, decided)).alias("precision"), p_lo.alias("precision_lo"), p_hi.alias("precision_hi"),
        F.when(ramps > 0, F.col("recall_tp") / F.when(ramps > 0, ramps)).alias("recall"), r_lo.alias("recall_lo"), r_hi.alias("recall_hi"),
    )


def sweep(seen: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """threshold, kept, precision, recall for thresholds that keep anything. Recall has the fixed
    denominator of all known objects. One pass: each detection is counted in the band below its
    confidence, the marks of a panorama with its first one; the few bands then add up to thresholds."""
    sure = F.size(F.filter("missed", lambda m: ~F.coalesce(m["unsure"], F.lit(False))))
    parts = seen.filter("judged").select("checked", sure.alias("sure"), F.posexplode_outer(F.arrays_zip("confs", "dets")).alias("i", "d"))
    conf, band = F.col("d.confs"), F.lit(-1)
    for i, t in enumerate(thresholds):
        band = F.when(conf >= t, i).otherwise(band)
    ok = F.col("d.dets") == "true"
    counts = {"kept": F.col("d.dets") != "unsure", "tp": ok, "rtp": ok & F.col("checked")}
    marks = F.sum(F.when(F.col("checked") & (F.coalesce("i", F.lit(0)) == 0), F.col("sure")).otherwise(0))
    by_band = parts.groupBy(band.alias("band")).agg(*(F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in counts.items()), marks.alias("marks"))
    # as many rows as bands go into one array
    one = by_band.agg(F.collect_list(F.struct("band", *counts)).alias("bands"), F.sum(F.col("rtp") + F.col("marks")).alias("ramps"))
    at = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("t")) for i, t in enumerate(thresholds)))
    total = lambda k: F.aggregate(F.filter("bands", lambda b: b["band"] >= F.col("x.i")), F.lit(0).cast("long"), lambda n, b: n + b[k]).alias(k)
    df = one.select("bands", "ramps", F.explode(at).alias("x")).select(F.col("x.t").alias("threshold"), "ramps", *map(total, counts)).filter("kept > 0")
    return df.select("threshold", "kept", (F.col("tp") / F.col("kept")).alias("precision"), F.when(F.col("ramps") > 0, F.col("rtp") / F.when(F.col("ramps") > 0, F.col("ramps"))).otherwise(F.lit(float("nan"))).alias("recall"))


def trusts_all(entries: DataFrame) -> DataFrame:
    """One row, ``legacy``: whether no entry says if it was checked for missed objects."""
    return entries.agg((~F.coalesce(F.max(F.col("no_missed").isNotNull()), F.lit(False))).alias("legacy"))


def lowest_threshold(swept: DataFrame, precision: float) -> DataFrame:
    """The lowest threshold from which on precision is reached."""
    return swept.filter(F.col("precision") >= precision).agg(F.min("threshold").alias("threshold"))
