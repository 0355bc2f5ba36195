"""Column expressions against plain arithmetic."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panoquarry.functions import geo, pixels
from panoquarry.operators import gallery, records, sampling


def test_pixels_round_half_to_even(spark):
    rows = spark.range(8193).select(F.col("id"), pixels.pixel(F.col("id") / 8192, F.lit(4096)).alias("p")).collect()
    assert all(r["p"] == round(r["id"] / 8192 * 4096) for r in rows)


@pytest.mark.parametrize(("good", "n"), [(7, 9), (40, 41), (123, 200), (3, 3000)])
def test_wilson(spark, good, n):
    """The bounds are the p for which good / n is just 1.96 standard errors away: roots of a square."""
    share, z = good / n, 1.96 * 1.96 / n
    a, b, c = 1 + z, -(2 * share + z), share * share
    roots = sorted((-b + sign * math.sqrt(b * b - 4 * a * c)) / (2 * a) for sign in (-1, 1))
    assert list(spark.range(1).select(*pixels.wilson(F.lit(good), F.lit(n))).first()) == pytest.approx(roots, abs=1e-12)


def test_wilson_without_trials(spark):
    assert list(spark.range(1).select(*pixels.wilson(F.lit(0), F.lit(0))).first()) == [0.0, 1.0]


def test_wilson_stays_in_range(spark):
    rows = [(k, n) for n in (1, 5, 100) for k in (0, n)]
    for r in spark.createDataFrame(rows, "k int, n int").select("k", "n", *(b.alias(a) for a, b in zip(("lo", "hi"), pixels.wilson(F.col("k"), F.col("n")), strict=True))).collect():
        assert 0 <= r["lo"] <= r["k"] / r["n"] <= r["hi"] + 1e-9 <= 1 + 1e-9


def test_tiles_as_plain_arithmetic(spark):
    places = [(0.0, 0.0), (44.058, -121.315), (-33.9, 151.2), (60.0, -179.99)]
    got = spark.createDataFrame(places, "lat double, lon double").select("lat", "lon", geo.tile_x(F.col("lon"), 17).alias("x"), geo.tile_y(F.col("lat"), 17).alias("y")).collect()
    assert all((r["x"], r["y"]) == geo.tile_at(r["lat"], r["lon"], 17) for r in got)


def test_crops_at_the_border(spark):
    df = spark.createDataFrame([("q", [(0.375, 0.5, 0.7), (0.015625, 0.984375, 0.6)])], "pid string, d array<struct<x_normalized:double,y_normalized:double,confidence:double>>")
    a, b = df.select(F.explode(gallery.crops(F.col("pid"), F.col("d"), F.lit(3200), F.lit(1600))).alias("c")).select("c.*").collect()
    # 1200 and 800, both in the middle of 512; 50 and 1575 next to the edges: left 0, top 1600 - 512
    assert (a["left"], a["top"], a["cx"], a["cy"], a["img"]) == (944, 544, 0.5, 0.5, "q_det0.jpg")
    assert (b["left"], b["top"], b["cx"], b["cy"], b["img"]) == (0, 1088, round(50 / 512, 4), round(487 / 512, 4), "q_det1.jpg")


def test_links_and_history(spark):
    about = "historical array<struct<id:string,date:struct<year:int,month:int>>>, links array<struct<pano_id:string,direction:double,address:array<struct<value:string>>>>"
    old = [("then", (2007, 3)), ("never", None), ("later", (2011, 12))]
    links = [("north", math.pi, [("Mill Lane",), ("B 12",)]), ("bare", math.pi / 6, []), ("none", 0.0, None)]
    df = spark.createDataFrame([(old, links), (None, None)], about).select(records.history(F.col("historical")).alias("h"), records.links(F.col("links")).alias("l"))
    full, none = df.collect()
    assert [tuple(h) for h in full["h"]] == [("then", "2007-03"), ("later", "2011-12")] and none["h"] == none["l"] == []
    assert [(round(x["yaw_deg"], 9), x["description"]) for x in full["l"]] == [(180.0, "Mill Lane"), (30.0, ""), (0.0, "")]


def test_sample(spark):
    rows = [(f"with{i:02}", 2 + i * i % 6, i) for i in range(43)] + [(f"bare{i}", 0, 43 + i) for i in range(7)]
    df = spark.createDataFrame(rows, "pid string, n_detections int, ordinal int").cache()
    pick = lambda **how: {(r["pid"], r["group"]) for r in sampling.choose(df, **how).collect()}
    got = pick(sample=21, empty=4)
    assert Counter(g for _, g in got) == {"top": 5, "random": 16, "empty": 4} and len({p for p, _ in got}) == 25
    assert got == pick(sample=21, empty=4) != pick(sample=21, empty=4, seed=3) and {g for _, g in pick(sample=2, empty=0)} == {"top"}
    # the densest, and of those that tie the earlier ones
    assert {p for p, g in got if g == "top"} == {p for p, *_ in sorted(rows, key=lambda r: (-r[1], r[2]))[:5]}
    assert pick(sample=500, empty=500) >= {(p, "empty") for p, n, _ in rows if not n}
