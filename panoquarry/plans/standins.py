"""Panoramas, detections, verdicts and marks derived from the star-schema tables, by arithmetic that
is the same in Spark and in SQL. The expressions are shared with the SQL of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AREA = {"type": "Polygon", "coordinates": [[[-121.37, 44.01], [-121.33, 44.003], [-121.26, 44.02], [-121.25, 44.08], [-121.29, 44.075], [-121.30, 44.12], [-121.36, 44.11], [-121.34, 44.06], [-121.37, 44.01]]]}
LAT = "43.999063e0 + (o_orderkey * 7919 % 10007) / 10007e0 * 0.124689e0"
LON = "-121.382433e0 + (o_orderkey * 104729 % 10009) / 10009e0 * 0.139084e0"
CONF = "0.55e0 + (l_quantity - 1e0) / 49e0 * 0.44e0"
X = "(l_partkey * 31 % 8192) / 8192e0"
Y = "(l_suppkey * 17 % 4096) / 4096e0"
WIDTH = "case when o_orderkey % 2 = 0 then 16384 else 13312 end"
HEIGHT = "case when o_orderkey % 2 = 0 then 8192 else 6656 end"
HEADING = "(o_orderkey % 6283) / 1000e0"
VERDICT = "case when o_orderkey % 17 = 0 then null when l_returnflag in ('A', 'N') then 'true' when l_linestatus = 'F' then 'false' else 'unsure' end"
#: Where a panorama was taken; the first is indoors.
SOURCE = "case when o_orderpriority = '1-URGENT' then 'innerspace' else 'launch' end"
#: Every nineteenth panorama has no date, every twenty-third no sizes, every twenty-ninth no tiles.
NO_DATE, NO_SIZES, NO_TILES = "o_orderkey % 19 = 0", "o_orderkey % 23 = 0", "o_orderkey % 29 = 0"
#: Some calls fail, some answers lack an angle.
FAILED, NO_ANGLE = "o_orderkey % 53 = 0", "o_orderkey % 31 = 0"
#: How many sizes a picture comes in; every seventh is three times as wide as high.
N_SIZES, WIDE = "(1 + o_orderkey % 6)", "o_orderkey % 7 = 0"
#: How many neighbours a panorama has; every fifth does not say. Every second one has a street.
N_LINKS, NO_LINKS = "(o_orderkey % 4)", "o_orderkey % 5 = 0"
#: What became of a panorama, by the rules above.
STATUS = f"case when o_orderpriority = '1-URGENT' then 'skipped' when {FAILED} then 'failure' when {NO_DATE} or {NO_SIZES} or {NO_TILES} then 'skipped' when {NO_ANGLE} then 'failure' else 'success' end"
REASON = f"case when o_orderpriority = '1-URGENT' then 'indoor' when {FAILED} then 'retry' when {NO_DATE} or {NO_SIZES} or {NO_TILES} then 'incomplete metadata' when {NO_ANGLE} then 'angles missing' end"
#: What a made service answers to a record.
HTTP = "case when o_orderkey % 5 = 0 then 201 when o_orderkey % 7 = 0 then 404 when o_orderkey % 11 = 0 then 503 else 200 end"
#: Every hundred-and-first review has one verdict too few.
SHORT = "o_orderkey % 101 = 0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(o_orderkey as string) as pid", f"{LAT} as lat", f"{LON} as lon", "o_orderstatus", "o_orderdate", "o_orderpriority", "o_custkey")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panos with their metadata as a service answers them, gaps included."""
    width = f"case when {WIDE} then 3 * ({HEIGHT}) else {WIDTH} end"
    sizes = f"transform(sequence(1, cast({N_SIZES} as int)), i -> if(i = {N_SIZES}, struct({width} as x, {HEIGHT} as y), struct(cast(256 * i as int) as x, cast(128 * i as int) as y)))"
    street = "if(i % 2 = 1, array(struct(concat('street ', pid) as value)), cast(array() as array<struct<value:string>>))"
    found = f"transform(slice(array(1, 2, 3), 1, cast({N_LINKS} as int)), i -> struct(concat(pid, '-', i) as pano_id, i / 10e0 as direction, {street} as address))"
    return panos(spark, sf_dir).selectExpr(
        "*", f"{SOURCE} as source", f"case when not ({NO_DATE}) then struct(year(o_orderdate) as year, month(o_orderdate) as month) end as date",
        f"case when {NO_SIZES} then cast(array() as array<struct<x:int,y:int>>) else {sizes} end as image_sizes", f"case when not ({NO_TILES}) then struct(512 as x, 512 as y) end as tile_size",
        f"case when not ({NO_ANGLE}) then {HEADING} end as heading", "0e0 as pitch", "0e0 as roll", "cast(null as string) as copyright_message",
        "cast(null as array<struct<id:string,date:struct<year:int,month:int>>>) as historical", f"case when not ({NO_LINKS}) then {found} end as links",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, and dets: array of (idx order, conf, x, y, flag, status), in order."""
    lines = table(spark, sf_dir, "lineitem")
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.expr(CONF).alias("confidence"), F.expr(X).alias("x_normalized"), F.expr(Y).alias("y_normalized"), "l_returnflag", "l_linestatus")
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("dets"))


def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, confs; panoramas without detections have none."""
    d = detections(spark, sf_dir)
    p = table(spark, sf_dir, "orders").select("o_orderkey")
    return p.join(d, p["o_orderkey"] == d["l_orderkey"], "left").select(F.col("o_orderkey").cast("string").alias("pid"), F.coalesce(F.transform("dets", lambda x: x["confidence"]), F.array().cast("array<double>")).alias("confs"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, missed, clicked of panoramas that events speak of."""
    n = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))
    e = table(spark, sf_dir, "events").filter("event_type in ('error', 'view', 'click')").crossJoin(F.broadcast(n))
    mark = F.when(F.col("event_type") != "click", F.struct(F.expr("least(value / 400e0, 1e0)").alias("x"), F.lit(0.5).alias("y"), (F.col("event_type") == "view").alias("unsure")))
    return e.groupBy(F.expr("event_id % n").alias("k")).agg(F.collect_list(mark).alias("missed"), F.max(F.col("event_type") == "click").alias("clicked"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, group, dets, missed, no_missed of the review of every panorama."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    d = detections(spark, sf_dir)
    df = o.join(d, o["o_orderkey"] == d["l_orderkey"], "left").join(marks(spark, sf_dir), F.col("k") == F.col("o_orderkey"), "left")
    n = F.coalesce(F.size(F.col("dets")), F.lit(0))
    df = df.select("o_orderkey", "o_orderstatus", "dets", F.coalesce("missed", F.array().cast("array<struct<x:double,y:double,unsure:boolean>>")).alias("missed"), F.coalesce("clicked", F.lit(False)).alias("clicked"), F.when(F.col("dets").isNull(), 0).otherwise(n).alias("n"))
    top = df.select("o_orderkey", "n").filter("n > 0").orderBy(F.desc("n"), "o_orderkey").limit(5).select("o_orderkey", F.lit(True).alias("is_top"))
    df = df.join(F.broadcast(top), "o_orderkey", "left")
    verdict = lambda x: F.when(F.col("o_orderkey") % 17 == 0, None).when(x["l_returnflag"].isin("A", "N"), "true").when(x["l_linestatus"] == "F", "false").otherwise("unsure")
    dets = F.coalesce(F.transform("dets", verdict), F.array().cast("array<string>"))
    dets = F.when(F.expr(SHORT) & (F.size(dets) > 0), F.slice(dets, 1, F.size(dets) - 1)).otherwise(dets)
    return df.select(
        F.col("o_orderkey").cast("string").alias("pid"), F.when(F.col("is_top"), "top").when(F.col("n") > 0, "random").otherwise("empty").alias("group"), dets.alias("dets"), "missed",
        F.when(F.col("o_orderstatus") != "P", F.col("clicked")).alias("no_missed"),
    )
