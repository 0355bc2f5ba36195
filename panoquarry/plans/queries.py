"""One query for each operator, over whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panoquarry.functions import geo, pixels
from panoquarry.operators import peaks as heat
from panoquarry.operators import gallery, records, sampling, scoring
from panoquarry.plans import standins as s
from panoquarry.plans.runs import found_in, settled
from panoquarry.streaming.incremental import fold_reviews

ZOOM = 17
RINGS = geo.rings(s.AREA)
_BOX = geo.bbox(RINGS)
PANOS = f"panos as (select o_orderkey, cast(o_orderkey as varchar) as pid, {s.LAT} as lat, {s.LON} as lon, o_orderstatus, o_orderdate, o_orderpriority from orders)"
EDGES = "edges(x1, y1, x2, y2) as (values " + ", ".join("(" + ", ".join(f"{v!r}e0" for v in e) + ")" for e in geo.edges(RINGS)) + ")"
INSIDE = (
    f"{PANOS}, {EDGES}, inside as (select p.* from panos p where lon between {_BOX[0]!r}e0 and {_BOX[2]!r}e0 and lat between {_BOX[1]!r}e0 and {_BOX[3]!r}e0"
    " and (select count(*) from edges where (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1"
    " and not exists (select 1 from edges where (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) = 0 and lon between least(x1, x2) and greatest(x1, x2) and lat between least(y1, y2) and greatest(y1, y2)))"
)
DETS = f"dets as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as idx, {s.CONF} as conf, {s.X} as x, {s.Y} as y, l_returnflag, l_linestatus from lineitem)"
MARKS = "marks as (select event_id % (select count(*) from orders) as k, count_if(event_type = 'error') as sure, count_if(event_type = 'view') as unsure, bool_or(event_type = 'click') as clicked, min(case when event_type != 'click' then least(value / 400e0, 1e0) end) as least_x from events where event_type in ('error', 'view', 'click') group by 1)"
TOP = "top as (select k from (select k, count(*) as n from dets group by k) order by n desc, k limit 5)"
#: Panoramas whose verdicts fit: whether all are judged and checked; and their decided detections.
REVIEW = (
    f"{DETS}, {MARKS}, {TOP}, panos as (select o.o_orderkey as k, cast(o.o_orderkey as varchar) as pid, o.o_orderkey in (select k from top) as is_top, coalesce(n, 0) as n,"
    " coalesce(m.sure, 0) as sure, coalesce(m.unsure, 0) as unsure, (o_orderkey % 17 != 0 or coalesce(n, 0) = 0) as judged,"
    " (o_orderstatus = 'P' or coalesce(m.clicked, false) or coalesce(m.sure, 0) + coalesce(m.unsure, 0) > 0) as done"
    f" from orders o left join (select k, count(*) as n from dets group by k) d on d.k = o.o_orderkey left join marks m on m.k = o.o_orderkey where not ({s.SHORT} and coalesce(n, 0) > 0)),"
    f" verdicts as (select d.k, p.pid, d.idx, d.conf, p.is_top, p.judged, p.done, {s.VERDICT.replace('o_orderkey', 'd.k')} as v from dets d join panos p on p.k = d.k)"
)


def _wilson(good: str, n: str) -> tuple[str, str]:
    z = 1.96
    m = f"cast({n} as double)"
    centre, margin, scale = f"({good} / {m} + {z * z!r}e0 / (2e0 * {m}))", f"{z!r}e0 * sqrt({good} / {m} * (1e0 - {good} / {m}) / {m} + {z * z!r}e0 / (4e0 * {m} * {m}))", f"(1e0 + {z * z!r}e0 / {m})"
    return tuple(f"case when {n} > 0 then {f}({edge}, {centre} / {scale} {sign} {margin} / {scale}) else {edge} end" for f, edge, sign in (("greatest", "0e0", "-"), ("least", "1e0", "+")))


def tile_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.panos(spark, sf_dir).select("pid", geo.tile_x(F.col("lon"), ZOOM).alias("x"), geo.tile_y(F.col("lat"), ZOOM).alias("y"))


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.tiles(spark.range(1), _BOX, ZOOM)


def area_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for r in RINGS for x, y in r))
    return spark.range(1).select(F.explode(points).alias("p")).agg(F.min("p.x").alias("west"), F.min("p.y").alias("south"), F.max("p.x").alias("east"), F.max("p.y").alias("north"))


def _inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.panos(spark, sf_dir).filter(geo.within(RINGS, F.col("lon"), F.col("lat")))


def pano_in_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inside(spark, sf_dir).select("pid", "lat", "lon")


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.panos(spark, sf_dir).filter("o_orderstatus = 'F'").select("pid")


def todo_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.todo(_inside(spark, sf_dir).select("pid"), _done(spark, sf_dir), "pid")


def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _inside(spark, sf_dir).join(_done(spark, sf_dir).withColumn("cached", F.lit(1)), "pid", "left")
    df = df.agg(F.count("*").alias("found"), F.count("cached").alias("cached"))
    left = F.col("found") - F.col("cached")
    return df.select("found", "cached", left.alias("todo"), pixels.runtime_hours(left).alias("hours"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of panoramas that a made service was asked for: indoor ones are skipped, calls fail,
    and the rest is settled by its metadata."""
    about = F.struct("source", "date", "image_sizes", "tile_size", "heading", "pitch", "roll", "links")
    indoor, failed = F.col("source").isin(*records.INDOOR), F.expr(s.FAILED)
    asked = s.metadata(spark, sf_dir).select(F.col("pid").alias("panorama_id"), about.alias("about"), F.when(indoor, "skipped").when(failed, "failure").otherwise("success").alias("status"), F.when(indoor, "indoor").when(failed, "retry").alias("reason"))
    return settled(asked).groupBy("status", "reason").agg(F.count("*").alias("n"))


def terminal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panoramas that no later run asks for again."""
    return records.terminal(s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("pid"), F.expr(s.STATUS).alias("status"))).select("pid")


def outdoor_panos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.metadata(spark, sf_dir).filter(~F.col("source").isin(*records.INDOOR)).select("pid", "source")


def record_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = s.metadata(spark, sf_dir).filter(~records.incomplete(F.col("date"), F.col("image_sizes"), F.col("tile_size")))
    last = F.element_at("image_sizes", -1)
    return df.select("pid", records.year_month(F.col("date")).alias("capture_date"), last["x"].alias("width"), last["y"].alias("height"), F.degrees("heading").alias("camera_heading"), pixels.zoom_level(F.col("image_sizes")).alias("zoom"), pixels.clamped_width(last["x"], last["y"]).alias("used_width"))


def history_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = lambda years: F.when((F.col("o_orderkey") + years) % 3 != 0, F.struct((F.year("o_orderdate") - years).alias("year"), F.month("o_orderdate").alias("month")))
    old = F.array(*(F.struct(F.concat("pid", F.lit(f"-{k}")).alias("id"), date(k).alias("date")) for k in (1, 2, 3)))
    df = s.panos(spark, sf_dir).select("pid", records.history(F.when(F.col("o_orderkey") % 11 != 0, old)).alias("h"))
    return df.select("pid", F.size("h").alias("n"), F.array_join(F.transform("h", lambda x: F.concat(x["pano_id"], F.lit("@"), x["date"])), ",").alias("history"))


def pixel_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = s.panos(spark, sf_dir), s.detections(spark, sf_dir)
    df = p.join(d, p["o_orderkey"] == d["l_orderkey"]).withColumn("labels", pixels.payload_labels(F.col("dets"), F.expr(s.WIDTH), F.expr(s.HEIGHT)))
    return df.select("pid", F.posexplode("labels").alias("i", "m")).select("pid", (F.col("i") + 1).cast("long").alias("idx"), "m.pano_x", "m.pano_y", "m.confidence")


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are numbered by key; every third has been submitted."""
    from panoquarry.sources.files import shared_folder, with_ordinal

    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    lines = with_ordinal(s.panos(spark, sf_dir).select("o_orderkey", "pid"), path, "o_orderkey").select(F.col("ordinal").alias("line_number"), "pid")
    sent = lines.filter("line_number % 3 = 0").select("line_number")
    return records.todo(lines, sent, "line_number")


def zero_detection_panos(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = s.table(spark, sf_dir, "lineitem").select("l_orderkey")
    p = s.panos(spark, sf_dir)
    return p.join(lines, p["o_orderkey"] == lines["l_orderkey"], "left_anti").select("pid")


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = s.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    p = s.panos(spark, sf_dir)
    return p.join(n, p["o_orderkey"] == n["l_orderkey"], "left").select("pid", F.coalesce("n", F.lit(0)).alias("n_detections"), F.col("o_orderkey").alias("ordinal"))


def top_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir).filter("n_detections > 0").orderBy(F.desc("n_detections"), "ordinal").limit(sampling.TOP).select("pid", "n_detections")


def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.choose(_counted(spark, sf_dir))


def crop_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = s.detections(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("pid"), F.posexplode("dets").alias("i", "d"))
    px, py = F.col("d.x_normalized") * 4096.0, F.col("d.y_normalized") * 2048.0
    df = d.select("pid", (F.col("i") + 1).cast("long").alias("idx"), px.alias("px"), py.alias("py"))
    df = df.withColumns({"left_px": pixels.crop_start(F.col("px"), 4096, 512), "top_px": pixels.crop_start(F.col("py"), 2048, 512)})
    return df.select("pid", "idx", "left_px", "top_px", pixels.in_crop(F.col("px"), F.col("left_px"), 512).alias("cx"), pixels.in_crop(F.col("py"), F.col("top_px"), 512).alias("cy"))


def _seen(spark: SparkSession, sf_dir: str, **how: bool) -> DataFrame:
    return scoring.reviewed(s.entries(spark, sf_dir), s.confidences(spark, sf_dir), **how)


def judged_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pool(_seen(spark, sf_dir))


def recall_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pool(_seen(spark, sf_dir), "checked")


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summary(_seen(spark, sf_dir))


def score_unbiased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summary(_seen(spark, sf_dir, exclude_top=True))


def score_attested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summary(_seen(spark, sf_dir, assume_scanned=True))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.sweep(_seen(spark, sf_dir))


def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = s.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).alias("n"))
    low, high = pixels.wilson(F.col("good"), F.col("n"))
    return df.select("k", "good", "n", low.alias("lo"), high.alias("hi"))


def missed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda flag: F.size(F.filter("missed", lambda m: m["unsure"] == flag)).cast("long")
    return s.marks(spark, sf_dir).select("k", n(F.lit(False)).alias("sure"), n(F.lit(True)).alias("unsure"), "clicked", F.array_min(F.transform("missed", lambda m: m["x"])).alias("least_x"))


def verdict_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.matched(s.entries(spark, sf_dir), s.confidences(spark, sf_dir)).filter("not fits").select("pid", F.size("confs").cast("long").alias("n_confs"), F.size("dets").cast("long").alias("n_verdicts"))


def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heat.peaks(s.table(spark, sf_dir, "embeddings"), F.col("embedding"), 8, 8, 1, 0.1).select("vec_id", "r", "c", F.col("value").cast("double").alias("value"))


def props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = s.metadata(spark, sf_dir), s.detections(spark, sf_dir)
    df = p.join(d, p["o_orderkey"] == d["l_orderkey"], "left").select(
        F.col("pid").alias("pano_id"), "lat", "lon", "source", "date", "image_sizes", "tile_size", "heading", "pitch", "roll", "copyright_message", "historical", "links",
        F.coalesce(F.transform("dets", lambda x: F.struct(x["x_normalized"].alias("x_normalized"), x["y_normalized"].alias("y_normalized"), x["confidence"].alias("confidence"))), F.array().cast("array<struct<x_normalized:double,y_normalized:double,confidence:double>>")).alias("detections"),
    )
    return records.build_records(df, "CurbRamp", "model", "01-01-2026", "v1")


def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.as_json(records.payloads(_records(spark, sf_dir)))


def record_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of the JSON finds: keys, values, nulls that are written, and no detections."""
    at = lambda path: F.get_json_object("payload", path)
    return record_json(spark, sf_dir).select(
        at("$.pano.panorama_id").alias("pid"), at("$.label_type").alias("label_type"), at("$.pano.capture_date").alias("capture_date"), at("$.pano.width").cast("int").alias("width"),
        F.json_array_length(at("$.labels")).cast("long").alias("n_labels"), at("$.labels[0].pano_x").cast("int").alias("first_x"), at("$.labels[0].confidence").cast("double").alias("first_conf"),
        F.json_array_length(at("$.pano.links")).cast("long").alias("n_links"), F.array_contains(F.json_object_keys("payload"), "detections").alias("has_detections"),
        F.array_contains(F.json_object_keys(at("$.pano")), "copyright").alias("has_copyright"),
    )


def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = [F.col(f"pano.{k}").alias(k) for k in ("panorama_id", "capture_date", "width", "height", "tile_width", "lat", "lng", "camera_heading", "camera_pitch", "source")]
    links = F.transform("pano.links", lambda x: F.concat_ws("/", x["target_gsv_panorama_id"], F.round(x["yaw_deg"]).cast("int").cast("string"), x["description"]))
    return _records(spark, sf_dir).select(*p, "label_type", "model_id", F.size("detections").cast("long").alias("n_detections"), F.size("pano.links").cast("long").alias("n_links"), F.array_join(links, ",").alias("links"))


def review_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks on a panorama with three detections, in the order of their events, as its review. Opening
    comes first; errors are marks, views turn a verdict, clicks say that nothing is missed."""
    e = s.table(spark, sf_dir, "events").filter("event_type in ('error', 'view', 'click')")
    kind = F.when(F.col("event_type") == "error", "mark").when(F.col("event_type") == "view", "cycle").otherwise("none")
    clicks = e.select(F.lit("run").alias("run_key"), F.col("user_id").cast("string").alias("pid"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 3).alias("i"), F.lit(3).cast("long").alias("n"), F.expr("least(value / 400e0, 1e0)").alias("x"), F.lit(0.5).alias("y"))
    first = clicks.select("run_key", "pid").distinct().select("run_key", "pid", F.lit(-1).cast("long").alias("seq"), F.lit("open").alias("kind"), F.lit(0).cast("long").alias("i"), F.lit(3).cast("long").alias("n"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    state = fold_reviews(first.unionByName(clicks))
    return state.select("pid", "seen", F.array_join("dets", ",", "-").alias("dets"), F.size("missed").cast("long").alias("n_missed"), "no_missed")


def area_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(geo.geometry_hash(s.AREA)).alias("area_hash"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, group, n and the state of its review; every seventh was never opened."""
    e = s.entries(spark, sf_dir)
    confs = s.confidences(spark, sf_dir).select("pid", F.size("confs").alias("n"))
    return e.join(confs, "pid").withColumn("seen", F.col("pid").cast("long") % 7 != 0)


def gallery_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The close-ups of the panoramas that a review sample shows."""
    d = s.detections(spark, sf_dir).withColumnRenamed("l_orderkey", "k")
    chosen = sampling.choose(_counted(spark, sf_dir))
    df = chosen.join(d, chosen["pid"] == d["k"].cast("string"), "left").select("pid", "group", F.coalesce("dets", F.array().cast(d.schema["dets"].dataType)).alias("dets"))
    df = df.select("pid", "group", F.posexplode(gallery.crops(F.col("pid"), F.col("dets"), F.lit(4096), F.lit(2048))).alias("i", "c"))
    return df.select("pid", "group", "c.img", "c.conf", "c.x", "c.y", "c.cx", "c.cy")


def gallery_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _states(spark, sf_dir)
    count = lambda mode: gallery.shown(states, mode).groupBy(F.lit(mode).alias("mode")).agg(F.count("*").alias("n"))
    out = count("all")
    for mode in ("det", "empty", "todo"):
        out = out.unionByName(count(mode))
    return out


def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gallery.progress(_states(spark, sf_dir))


def verdict_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _states(spark, sf_dir)
    return gallery.export(states, states).select("pid", "verdict.group", F.array_join("verdict.dets", ",", "-").alias("dets"), F.size("verdict.missed").cast("long").alias("n_missed"), "verdict.no_missed")


def verdict_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = s.entries(spark, sf_dir).select(F.explode("dets").alias("v"))
    return df.groupBy(pixels.verdict_label(F.col("v")).alias("label")).agg(F.count("*").alias("n"))


def legacy_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.trusts_all(s.entries(spark, sf_dir))


def score_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all, and that without the densest where it differs in what was seen."""
    whole = scoring.summary(_seen(spark, sf_dir)).withColumn("report", F.lit("all"))
    rest = scoring.summary(_seen(spark, sf_dir, exclude_top=True)).withColumn("report", F.lit("unbiased"))
    differs = rest.join(F.broadcast(whole.select(F.col("n_seen").alias("n_all"))), F.col("n_seen") != F.col("n_all")).drop("n_all")
    return whole.unionByName(differs).select("report", "n_seen", "n_judged", "tp", "fp", "recall_tp", "missed", "precision", "recall")


def calibrated_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.lowest_threshold(threshold_sweep(spark, sf_dir), 0.8)


def coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panoramas that tiles found, each from two tiles; every thirteenth tile failed."""
    p = s.panos(spark, sf_dir).withColumns({"x": geo.tile_x(F.col("lon"), ZOOM), "y": geo.tile_y(F.col("lat"), ZOOM)}).withColumn("ok", (F.col("x") + F.col("y")) % 13 != 0)
    twice = p.unionByName(p.withColumn("x", F.col("x") + 1)).withColumnRenamed("pid", "panorama_id")
    return found_in(twice, RINGS).select(F.col("panorama_id").alias("pid"), "lat", "lon")


def failed_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = s.panos(spark, sf_dir).select(geo.tile_x(F.col("lon"), ZOOM).alias("x"), geo.tile_y(F.col("lat"), ZOOM).alias("y"))
    return p.filter((F.col("x") + F.col("y")) % 13 == 0).agg(F.count_distinct("x", "y").alias("n"))


def submission_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a made service, by what becomes of their records."""
    return s.table(spark, sf_dir, "orders").groupBy(records.outcome(F.expr(s.HTTP)).alias("outcome")).agg(F.count("*").alias("n"))


def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of the records of each panorama: a line is a record with one detection."""
    lines = s.table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"), F.array(F.struct(F.expr(s.CONF).alias("confidence"))).alias("detections"))
    return records.latest(lines, F.col("l_orderkey").cast("string"), "at").select("pid", F.col("confs")[0].alias("conf"))


def first_with_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir).filter("n_detections > 0").orderBy("ordinal").limit(1).select("pid", "n_detections")


def marker_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections on a download of 4096 x 2048."""
    p, d = s.panos(spark, sf_dir), s.detections(spark, sf_dir)
    df = p.join(d, p["o_orderkey"] == d["l_orderkey"]).select("pid", F.expr(s.WIDTH).alias("w"), F.expr(s.HEIGHT).alias("h"), F.posexplode("dets").alias("i", "d"))
    return df.select("pid", (F.col("i") + 1).cast("long").alias("idx"), pixels.on_download(F.col("d.x_normalized"), F.col("w"), F.lit(4096)).alias("px"), pixels.on_download(F.col("d.y_normalized"), F.col("h"), F.lit(2048)).alias("py"))


def pano_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counted(spark, sf_dir)
    return c.select("pid", pixels.pano_url(F.col("pid")).alias("url"), pixels.pano_title(F.col("pid"), F.lit("2021-06"), F.col("n_detections"), F.lit("random")).alias("title"))


QUERIES = {
    f.__name__: f
    for f in (
        score_summary, score_unbiased, score_attested, threshold_sweep, judged_pool, recall_pool, wilson, missed_marks, verdict_mismatch,
        tile_of_point, tile_grid, area_bbox, pano_in_area, todo_anti_join, scan_summary, status_counts, record_units, history_filter,
        pixel_payload, resume_anti_join, zero_detection_panos, top_dense, review_sample, crop_window, local_peaks, props_extract, record_json, record_fields,
        gallery_crops, gallery_modes, review_progress, verdict_export, verdict_labels, legacy_verdicts, score_reports, calibrated_threshold,
        coverage_merge, failed_tiles, submission_summary, latest_record, first_with_detections, marker_places, pano_titles,
        record_json_fields, review_fold, area_hash, terminal_ids, outdoor_panos,
    )
}

_N = float(1 << ZOOM)
_TILE = (f"cast(trunc((lon + 180e0) / 360e0 * {_N!r}e0) as integer)", f"cast(trunc((1e0 - asinh(tan(radians(lat))) / pi()) / 2e0 * {_N!r}e0) as integer)")
#: The corners of the area as they are given.
_POINTS = "points(lon, lat) as (values " + ", ".join(f"({x!r}e0, {y!r}e0)" for ring in s.AREA["coordinates"] for x, y in ring) + ")"
_WHOLE = f"not ({s.NO_DATE} or {s.NO_SIZES} or {s.NO_TILES})"
_WIDTH = f"(case when {s.WIDE} then 3 * ({s.HEIGHT}) else {s.WIDTH} end)"
_LINKS = f"list_transform(range(1, case when {s.NO_LINKS} then 0 else {s.N_LINKS} end + 1), lambda i: pid || '-' || i || '/' || round(degrees(i / 10e0))::int || '/' || case when i % 2 = 1 then 'street ' || pid else '' end)"


def _summary(keep: str, checked: str) -> str:
    (p_lo, p_hi), (r_lo, r_hi) = _wilson("tp", "(tp + fp)"), _wilson("recall_tp", "(recall_tp + missed)")
    return (
        f"with {REVIEW}, a as (select count(*) as n_seen, count_if(judged) as n_judged, count_if(judged and not ({checked})) as n_unconfirmed, coalesce(sum(case when judged and ({checked}) then sure end), 0)::bigint as missed, coalesce(sum(case when judged and ({checked}) then unsure end), 0)::bigint as missed_unsure from panos where {keep}),"
        f" b as (select count_if(judged and v = 'unsure') as n_unsure, count_if(judged and v = 'true') as tp, count_if(judged and v = 'false') as fp, count_if(judged and ({checked}) and v = 'true') as recall_tp from verdicts where {keep})"
        f" select n_seen, n_judged, n_unconfirmed, n_unsure, tp, fp, recall_tp, missed, missed_unsure, tp / nullif(tp + fp, 0)::double as precision, {p_lo} as precision_lo, {p_hi} as precision_hi, recall_tp / nullif(recall_tp + missed, 0)::double as recall, {r_lo} as recall_lo, {r_hi} as recall_hi from a, b"
    )


_SORTED = "seeded as (select pid, n_detections, row_number() over (partition by n_detections = 0, is_top order by md5('0:' || pid), pid) as r, is_top from counted)"
_COUNTED = "c0 as (select cast(o_orderkey as varchar) as pid, o_orderkey, coalesce(n, 0) as n_detections from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey)"
_HISTORY = "list_filter([" + ", ".join(f"case when o_orderkey % 11 != 0 and (o_orderkey + {k}) % 3 != 0 then pid || '-{k}@' || (year(o_orderdate) - {k}) || '-' || lpad(month(o_orderdate)::varchar, 2, '0') end" for k in (1, 2, 3)) + "], lambda x: x is not null)"
#: The review of every panorama with its state, and its verdicts, cut short where one is missing.
_STATES = (
    f"{DETS}, {MARKS}, {TOP}, vs as (select d.k, d.idx, {s.VERDICT.replace('o_orderkey', 'd.k')} as v, count(*) over (partition by d.k) as n from dets d),"
    f" cut as (select k, array_agg(v order by idx) as dets from vs where not ({s.SHORT.replace('o_orderkey', 'k')} and idx = n) group by k),"
    f" st as (select cast(o_orderkey as varchar) as pid, o_orderkey % 7 != 0 as seen, coalesce(c.n, 0) as n, coalesce(u.dets, []) as dets, coalesce(m.sure, 0) as sure, coalesce(m.unsure, 0) as unsure, o_orderstatus != 'P' and coalesce(m.clicked, false) as no_missed,"
    " case when o_orderkey in (select k from top) then 'top' when coalesce(c.n, 0) > 0 then 'random' else 'empty' end as grp"
    " from orders left join (select k, count(*) as n from dets group by k) c on c.k = o_orderkey left join cut u on u.k = o_orderkey left join marks m on m.k = o_orderkey),"
    " rv as (select *, seen and (sure + unsure > 0 or no_missed) and len(dets) = n and len(list_filter(dets, lambda v: v is null)) = 0 as reviewed from st)"
)
SQL = {
    "tile_of_point": f"with {PANOS} select pid, {_TILE[0]} as x, {_TILE[1]} as y from panos",
    # x grows east, y grows south: corners in a row of x and a column of y
    "tile_grid": f"with {_POINTS}, t as (select min({_TILE[0]}) as x0, max({_TILE[0]}) as x1, min({_TILE[1]}) as y0, max({_TILE[1]}) as y1 from points), xs as (select unnest(range(x0, x1 + 1))::int as x from t), ys as (select unnest(range(y0, y1 + 1))::int as y from t) select x, y from xs, ys",
    "area_bbox": f"with {_POINTS} select min(lon) as west, min(lat) as south, max(lon) as east, max(lat) as north from points",
    "area_hash": f"select sha256('{json.dumps(s.AREA, sort_keys=True, separators=(',', ':'))}') as area_hash",
    "terminal_ids": f"select cast(o_orderkey as varchar) as pid from orders where {s.STATUS} in ('success', 'skipped')",
    "outdoor_panos": "select cast(o_orderkey as varchar) as pid, 'launch' as source from orders where o_orderpriority != '1-URGENT'",
    "pano_in_area": f"with {INSIDE} select pid, lat, lon from inside",
    "todo_anti_join": f"with {INSIDE} select pid from inside where pid not in (select pid from panos where o_orderstatus = 'F')",
    "scan_summary": f"with {INSIDE} select count(*) as found, count_if(o_orderstatus = 'F') as cached, count_if(o_orderstatus != 'F') as todo, count_if(o_orderstatus != 'F') * 1.5e0 / 3600e0 as hours from inside",
    "status_counts": f"select {s.STATUS} as status, {s.REASON} as reason, count(*) as n from orders group by 1, 2",
    "record_units": f"with {PANOS} select pid, year(o_orderdate) || '-' || lpad(month(o_orderdate)::varchar, 2, '0') as capture_date, {_WIDTH} as width, {s.HEIGHT} as height, case when not ({s.NO_ANGLE}) then degrees({s.HEADING}) end as camera_heading, least(3, o_orderkey % 6)::int as zoom, least({_WIDTH}, 2 * ({s.HEIGHT})) as used_width from panos where {_WHOLE}",
    "history_filter": f"with {PANOS} select pid, len({_HISTORY})::int as n, array_to_string({_HISTORY}, ',') as history from panos",
    "pixel_payload": f"with {DETS} select cast(k as varchar) as pid, idx, round_even(x * ({s.WIDTH}), 0)::int as pano_x, round_even(y * ({s.HEIGHT}), 0)::int as pano_y, conf as confidence from dets join orders on o_orderkey = k",
    "resume_anti_join": "with l as (select row_number() over (order by o_orderkey) as line_number, cast(o_orderkey as varchar) as pid from orders) select * from l where line_number % 3 != 0",
    "zero_detection_panos": "select cast(o_orderkey as varchar) as pid from orders where o_orderkey not in (select l_orderkey from lineitem)",
    "top_dense": f"with {_COUNTED} select pid, n_detections from c0 where n_detections > 0 order by n_detections desc, o_orderkey limit 5",
    "review_sample": f"with {_COUNTED}, t as (select pid from c0 where n_detections > 0 order by n_detections desc, o_orderkey limit 5), counted as (select *, pid in (select pid from t) as is_top from c0), {_SORTED} select pid, n_detections, case when is_top then 'top' when n_detections = 0 then 'empty' else 'random' end as \"group\" from seeded where is_top or r <= case when n_detections = 0 then 10 else 95 end",
    "crop_window": f"with {DETS}, p as (select cast(k as varchar) as pid, idx, x * 4096e0 as px, y * 2048e0 as py from dets), w as (select *, trunc(least(greatest(px - 256e0, 0e0), 3584e0))::int as left_px, trunc(least(greatest(py - 256e0, 0e0), 1536e0))::int as top_px from p) select pid, idx, left_px, top_px, round((px - left_px) / 512e0, 4) as cx, round((py - top_px) / 512e0, 4) as cy from w",
    "judged_pool": f"with {REVIEW} select pid, idx, conf, v = 'true' as ok from verdicts where judged and v != 'unsure'",
    "recall_pool": f"with {REVIEW} select pid, idx, conf, v = 'true' as ok from verdicts where judged and done and v != 'unsure'",
    "score_summary": _summary("true", "done"),
    "score_unbiased": _summary("not is_top", "done"),
    "score_attested": _summary("true", "true"),
    "threshold_sweep": f"with {REVIEW}, t(threshold) as (values {', '.join(f'({x!r}e0)' for x in scoring.THRESHOLDS)}), r as (select (select count(*) from verdicts where judged and done and v = 'true') + (select sum(sure) from panos where judged and done) as ramps) select threshold, count(*) as kept, count_if(v = 'true') / count(*)::double as precision, count_if(v = 'true' and done) / (select ramps from r)::double as recall from t join verdicts on conf >= threshold where judged and v != 'unsure' group by 1",
    "wilson": "with a as (select l_suppkey as k, count_if(l_returnflag = 'A') as good, count_if(l_returnflag != 'R') as n from lineitem group by 1) select k, good, n, {} as lo, {} as hi from a".format(*_wilson("good", "n")),
    "missed_marks": f"with {MARKS} select k, sure, unsure, clicked, least_x from marks",
    "verdict_mismatch": f"with {DETS} select cast(k as varchar) as pid, count(*) as n_confs, count(*) - 1 as n_verdicts from dets join orders on o_orderkey = k where {s.SHORT} group by k",
    "local_peaks": "with e as (select vec_id, unnest(range(64)) as i, unnest(embedding) as v from embeddings), g as (select vec_id, i // 8 as r, i % 8 as c, v from e) select vec_id, r::int as r, c::int as c, v::double as value from g a where r between 1 and 6 and c between 1 and 6 and v::double > 0.1e0 and v >= (select max(b.v) from g b where b.vec_id = a.vec_id and b.r between a.r - 1 and a.r + 1 and b.c between a.c - 1 and a.c + 1)",
    "props_extract": "select json_extract_string(props, '$.k') as k, count(*) as n from events group by 1",
}
SQL |= {
    "record_fields": f"with {PANOS} select pid as panorama_id, year(o_orderdate) || '-' || lpad(month(o_orderdate)::varchar, 2, '0') as capture_date, {_WIDTH} as width, {s.HEIGHT} as height, 512 as tile_width, lat, lon as lng, case when not ({s.NO_ANGLE}) then degrees({s.HEADING}) end as camera_heading, 0e0 as camera_pitch, {s.SOURCE} as source, 'CurbRamp' as label_type, 'model' as model_id, (select count(*) from lineitem where l_orderkey = o_orderkey) as n_detections, len({_LINKS}) as n_links, array_to_string({_LINKS}, ',') as links from panos where {_WHOLE}",
    "record_json_fields": f"with {PANOS}, {DETS}, f as (select k, count(*) as n, arg_min(x, idx) as x, arg_min(conf, idx) as conf from dets group by k) select pid, 'CurbRamp' as label_type, year(o_orderdate) || '-' || lpad(month(o_orderdate)::varchar, 2, '0') as capture_date, {_WIDTH} as width, coalesce(n, 0) as n_labels, round_even(x * {_WIDTH}, 0)::int as first_x, conf as first_conf, len({_LINKS}) as n_links, false as has_detections, true as has_copyright from panos left join f on k = o_orderkey where {_WHOLE}",
    # a verdict turns once for each view of its number; a mark revokes and forbids that nothing is missed
    "review_fold": "with e as (select cast(user_id as varchar) as pid, event_id, event_type from events where event_type in ('error', 'view', 'click')), v as (select pid, i, count_if(event_type = 'view' and event_id % 3 = i) % 4 as turns from e, range(3) t(i) group by pid, i), d as (select pid, string_agg(['-', 'true', 'false', 'unsure'][(turns + 1)::bigint], ',' order by i) as dets from v group by pid) select pid, true as seen, dets, count_if(event_type = 'error') as n_missed, count_if(event_type = 'error') = 0 and count_if(event_type = 'click') % 2 = 1 as no_missed from e join d using (pid) group by pid, dets",
    "gallery_crops": f"with sample as ({SQL['review_sample']}), {DETS}, p as (select s.pid, s.\"group\", idx, conf, x, y, x * 4096e0 as px, y * 2048e0 as py from sample s join dets on cast(k as varchar) = s.pid), w as (select *, trunc(least(greatest(px - 256e0, 0e0), 3584e0)) as l, trunc(least(greatest(py - 256e0, 0e0), 1536e0)) as t from p)"
    " select pid, \"group\", pid || '_det' || (idx - 1) || '.jpg' as img, round(conf, 4) as conf, round(x, 5) as x, round(y, 5) as y, round((px - l) / 512e0, 4) as cx, round((py - t) / 512e0, 4) as cy from w",
    "gallery_modes": f"with {_STATES} select 'all' as mode, count(*) as n from rv union all select 'det', count(*) from rv where n > 0 union all select 'empty', count(*) from rv where n = 0 union all select 'todo', count(*) from rv where not reviewed",
    "review_progress": f"with {_STATES} select count_if(reviewed) as reviewed, count(*) as entries, sum(sure)::bigint as sure, sum(unsure)::bigint as unsure from rv",
    "verdict_export": f"with {_STATES} select pid, grp as \"group\", array_to_string(list_transform(dets, lambda v: coalesce(v, '-')), ',') as dets, sure + unsure as n_missed, no_missed from rv where seen",
    "verdict_labels": f"with {_STATES}, v as (select unnest(dets) as v from rv) select case v when 'true' then 'correct' when 'false' then 'incorrect' when 'unsure' then 'unsure' else 'unjudged' end as label, count(*) as n from v group by 1",
    "legacy_verdicts": "select count_if(o_orderstatus != 'P') = 0 as legacy from orders",
    "score_reports": f"with a as ({SQL['score_summary']}), b as ({SQL['score_unbiased']}) select 'all' as report, n_seen, n_judged, tp, fp, recall_tp, missed, precision, recall from a union all select 'unbiased', b.n_seen, b.n_judged, b.tp, b.fp, b.recall_tp, b.missed, b.precision, b.recall from b, a where a.n_seen != b.n_seen",
    "calibrated_threshold": f"select min(threshold) as threshold from ({SQL['threshold_sweep']}) where precision >= 0.8e0",
    "coverage_merge": f"with {INSIDE}, t as (select *, {_TILE[0]} as x, {_TILE[1]} as y from inside) select pid, lat, lon from t where (x + y) % 13 != 0",
    "failed_tiles": f"with {PANOS}, t as (select distinct {_TILE[0]} as x, {_TILE[1]} as y from panos) select count(*) as n from t where (x + y) % 13 = 0",
    "submission_summary": f"select case when {s.HTTP} = 200 then 'success' when {s.HTTP} between 400 and 499 then 'rejected' else 'error' end as outcome, count(*) as n from orders group by 1",
    "latest_record": f"select cast(l_orderkey as varchar) as pid, arg_max({s.CONF}, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) as conf from lineitem group by 1",
    "first_with_detections": f"with {_COUNTED} select pid, n_detections from c0 where n_detections > 0 order by o_orderkey limit 1",
    "marker_places": f"with {DETS} select cast(k as varchar) as pid, idx, x * ({s.WIDTH}) * (4096e0 / ({s.WIDTH})) as px, y * ({s.HEIGHT}) * (2048e0 / ({s.HEIGHT})) as py from dets join orders on o_orderkey = k",
    "pano_titles": f"with {_COUNTED} select pid, 'https://www.google.com/maps/@?api=1&map_action=pano&pano=' || pid as url, pid || ' captured 2021-06 - ' || n_detections || ' detection(s) random' as title from c0",
}
