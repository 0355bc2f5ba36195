"""Result records from metadata and detections, statuses, payloads, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panoquarry.functions.pixels import payload_labels

#: Sources that are indoors.
INDOOR = ("innerspace", "cultural_institute", "photos:legacy_innerspace")


def year_month(date: Column) -> Column:
    return F.format_string("%d-%02d", date["year"], date["month"])


def incomplete(date: Column, image_sizes: Column, tile_size: Column) -> Column:
    return date.isNull() | image_sizes.isNull() | (F.size(image_sizes) == 0) | tile_size.isNull()


def history(old: Column) -> Column:
    """Dated entries only; none for null."""
    dated = F.filter(F.coalesce(old, F.array()), lambda h: h["date"].isNotNull())
    return F.transform(dated, lambda h: F.struct(h["id"].alias("pano_id"), year_month(h["date"]).alias("date")))


def links(found: Column) -> Column:
    return F.transform(
        F.coalesce(found, F.array()),
        lambda x: F.struct(x["pano_id"].alias("target_gsv_panorama_id"), F.degrees(x["direction"]).alias("yaw_deg"), F.when(F.size(x["address"]) > 0, x["address"][0]["value"]).otherwise("").alias("description")),
    )


def build_records(df: DataFrame, label_type: str, model_id: str, model_training_date: str, api_version: str) -> DataFrame:
    """Result records of rows of metadata with detections; incomplete metadata give none."""
    whole = df.filter(~incomplete(F.col("date"), F.col("image_sizes"), F.col("tile_size")))
    last = F.element_at("image_sizes", -1)
    pano = F.struct(
        F.col("pano_id").alias("panorama_id"), year_month(F.col("date")).alias("capture_date"), last["x"].alias("width"), last["y"].alias("height"),
        F.col("tile_size.x").alias("tile_width"), F.col("tile_size.y").alias("tile_height"), "lat", F.col("lon").alias("lng"),
        *(F.degrees(k).alias(f"camera_{k}") for k in ("heading", "pitch", "roll")),
        F.col("copyright_message").alias("copyright"), "source", history(F.col("historical")).alias("history"), links(F.col("links")).alias("links"),
    )
    return whole.select("detections", F.lit(label_type).alias("label_type"), F.lit(model_id).alias("model_id"), F.lit(model_training_date).alias("model_training_date"), F.lit(api_version).alias("api_version"), pano.alias("pano"))


def payloads(records: DataFrame) -> DataFrame:
    """Records with labels in pixels instead of normalised detections."""
    return records.withColumn("labels", payload_labels(F.col("detections"), F.col("pano.width"), F.col("pano.height"))).drop("detections")


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("payload"))


def todo(found: DataFrame, done: DataFrame, key: str = "panorama_id") -> DataFrame:
    """What is found and not done. Only terminal outcomes belong into done: failures come again."""
    return found.join(done.select(key).distinct(), key, "left_anti")


def outcome(status: Column) -> Column:
    """What becomes of a record that was answered with an HTTP status: only 200 counts as taken, and
    4xx is not tried again in the same run."""
    return F.when(status == 200, "success").when(status.between(400, 499), "rejected").otherwise("error")


def terminal(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("status").isin("success", "skipped"))


def latest(records: DataFrame, key: Column, ordinal: str) -> DataFrame:
    """key and confidences of the last record of each key."""
    confs = F.transform("detections", lambda d: d["confidence"])
    return records.groupBy(key.alias("pid")).agg(F.max_by(confs, F.col(ordinal)).alias("confs"))
