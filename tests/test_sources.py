"""Run files, service calls, peaks and review folding on small made inputs."""

import json

import numpy as np
import pytest

from panoquarry.functions import geo
from panoquarry.operators.peaks import peaks_of
from panoquarry.sources import files, network
from panoquarry.streaming.incremental import fold_reviews, follow_reviews, once


def test_caches(spark, tmp_path):
    (tmp_path / "c").write_text("lime\nteak\nlime\nlime\nelder\n")
    (tmp_path / "s").write_text("\n12\n5\n\n12\n700\n")
    assert sorted(r[0] for r in files.processed_ids(spark, f"{tmp_path}/c").collect()) == ["elder", "lime", "teak"]
    assert sorted(r[0] for r in files.submitted_lines(spark, f"{tmp_path}/s").collect()) == [5, 12, 700]
    assert files.processed_ids(spark, f"{tmp_path}/none").count() == 0


def test_results_strict_and_tolerant(spark, tmp_path):
    good = json.dumps({"detections": [], "pano": {"panorama_id": "p"}})
    (tmp_path / "r.jsonl").write_text(f"{good}\n\nnot json\n")
    rows = files.results_tolerant(spark, f"{tmp_path}/r.jsonl").collect()
    assert sorted(r["_corrupt_record"] is None for r in rows) == [False, True]
    with pytest.raises(Exception):
        files.results(spark, f"{tmp_path}/r.jsonl").collect()


def test_tiles():
    assert geo.tile_at(0, 0, 0) == (0, 0) and geo.tile_at(44.058, -121.315, 17) == (21366, 47630)


def test_submission(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "line_number long, payload string")
    got = network.submitted(df, lambda b: {"a": 200, "b": 404, "c": 201}[b], lambda t: None).collect()
    assert sorted(map(tuple, got)) == [(1, "success"), (2, "rejected"), (3, "error")]


def test_review_fold(spark):
    kinds = [("open", 0, 2), ("cycle", 0, 0), ("none", 0, 0), ("mark", 0, 0), ("none", 0, 0), ("touch", 0, 0), ("cycle", 1, 0), ("cycle", 1, 0)]
    df = spark.createDataFrame([("r", "p", i, k, a, n, 0.5, 0.5) for i, (k, a, n) in enumerate(kinds)], "run_key string, pid string, seq long, kind string, i long, n long, x double, y double")
    r = fold_reviews(df).first()
    assert r["dets"] == ["true", "false"] and r["missed"][0]["unsure"] and not r["no_missed"] and r["seen"]


def test_review_stream_keeps_state(spark, tmp_path):
    schema = "run_key string, pid string, seq long, kind string, i long, n long, x double, y double"
    batches = [[(1, "open", 0, 2), (2, "cycle", 0, 0)], [(4, "mark", 0, 0), (3, "none", 0, 0), (5, "touch", 0, 0)], [(6, "cycle", 0, 0), (7, "touch", 0, 0)]]
    seen = []
    for rows in batches:
        spark.createDataFrame([("r", "p", q, k, i, n, 0.5, 0.5) for q, k, i, n in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = follow_reviews(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        put = lambda df, _: seen.extend(r.asDict(True) for r in df.collect())
        out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    assert [r["dets"] for r in seen] == [["true", None], ["true", None], ["false", None]]
    assert [len(r["missed"]) for r in seen] == [0, 1, 0] and seen[1]["missed"][0]["unsure"] and not seen[1]["no_missed"]


def test_once_across_runs(spark, tmp_path):
    for ids in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(i,) for i in ids], "id string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        once(spark, f"{tmp_path}/in", "id string", "id", f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]


def test_peaks_of():
    heat = np.zeros((40, 60))
    heat[20, 30], heat[22, 33], heat[5, 30] = 1.4, 0.9, 0.9
    assert peaks_of(heat) == [(0.5, 0.5, 1.4)]


def test_equal_peaks_close_to_each_other_are_one():
    heat = np.zeros((40, 60))
    heat[20, 30], heat[20, 33], heat[20, 45] = 1.2, 1.5, 0.6
    assert [(r, c) for c, r, _ in peaks_of(heat)] == [(0.5, 0.5), (0.5, 0.75)] and peaks_of(np.ones((40, 60))) == []


def test_detector_loads_once():
    from panoquarry.functions import detector

    loads, heat = [], np.zeros((30, 60))
    heat[15, 30] = 0.8

    def load():
        loads.append(1)
        return lambda pixels: heat if pixels.shape == (3, 4, 8) else None

    d = detector.Detector("made", load, size=(4, 8))
    picture = np.zeros((4, 9, 3), dtype=np.uint8)
    assert d(picture) == d(picture) == [(0.5, 0.5, 0.8)] and loads == [1]
    assert detector.best_device(lambda name: name == "mps") == "mps" and detector.best_device(lambda name: False) == "cpu"


def test_pictures_are_brought_to_the_size_of_the_model():
    from panoquarry.functions.detector import resized, two_to_one

    ramp = np.repeat(np.arange(0, 240, 10, dtype=np.uint8)[None, :, None], 12, 0).repeat(3, 2)
    assert resized(ramp, (12, 24)) is ramp and resized(ramp, None) is ramp
    half = resized(ramp, (6, 12))
    # halves of pairs, smoothed over the neighbours: a ramp stays a ramp
    assert half.shape == (6, 12, 3) and half[2, 1:-1, 0].tolist() == [25 + 20 * i for i in range(10)]
    twice = resized(ramp, (24, 48))
    assert twice.shape == (24, 48, 3) and twice[0, 1, 0] in (2, 3) and twice[0, 2, 0] in (7, 8) and (np.diff(twice[5, :, 1].astype(int)) >= 0).all()
    assert two_to_one(np.zeros((10, 35, 3))).shape == (10, 20, 3) and resized(np.full((7, 9, 3), 200, np.uint8), (4, 5)).min() == 200


def test_jpeg_sizes_and_qualities(tmp_path):
    from panoquarry.functions.pictures import Jpeg

    done = []

    class Made:
        def __init__(self, *about):
            self.about = about

        def crop(self, box):
            return Made("crop", box)

        def resize(self, size, how):
            return Made("resize", size, how)

        def convert(self, mode):
            return Made(*self.about, mode)

        def save(self, path, quality):
            done.append((*self.about, path, quality))

    keep = Jpeg(f"{tmp_path}/images")
    keep(Made(), (1, 2, 3, 4), "a_det0.jpg")
    keep(Made(), None, "a_full.jpg")
    assert done == [("crop", (1, 2, 3, 4), "RGB", f"{tmp_path}/images/a_det0.jpg", 85), ("resize", (1600, 800), 2, "RGB", f"{tmp_path}/images/a_full.jpg", 80)]


def test_calls_do_not_wait_for_ever(monkeypatch):
    import socket

    set_to = []
    monkeypatch.setattr(socket, "getdefaulttimeout", lambda: None)
    monkeypatch.setattr(socket, "setdefaulttimeout", set_to.append)
    network._bounded()
    assert set_to == [30.0]


def test_peaks_of_a_large_map(spark):
    """As an expression over the array, against the same in numpy."""
    from panoquarry.operators.peaks import peaks

    rng = np.random.default_rng(4)
    heat = rng.random((64, 128))
    df = spark.createDataFrame([(1, heat.ravel().tolist())], "id int, heat array<double>")
    got = {(r["r"], r["c"]) for r in peaks(df, df["heat"], 64, 128, 5, 0.9).collect()}
    assert got and got == {(round(y * 64), round(x * 128)) for x, y, _ in peaks_of(heat, 5, 0.9)}


def test_post_says_the_status(tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from panoquarry.__main__ import Post, arguments

    got = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append((self.headers["Authorization"], self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200 if len(got) == 1 else 404)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    post = Post(f"http://127.0.0.1:{server.server_port}/x", "key")
    assert [post("{}"), post("{}")] == [200, 404] and got[0] == ("Bearer key", b"{}")
    server.shutdown()
    assert arguments(["submit", "f", "--dry-run"]).dry_run and arguments(["gallery", "r", "--services", "m"]).sample == 100


def test_within_an_area_of_many_edges(spark):
    import math
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    ring = [((1 + 0.6 * rng.random()) * math.cos(a), (1 + 0.6 * rng.random()) * math.sin(a)) for a in (2 * math.pi * i / 400 for i in range(400))]
    hole = [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.25), (-0.5, 0.25)]
    area = geo.rings({"type": "MultiPolygon", "coordinates": [[[*ring, ring[0]], [*hole, hole[0]]], [[(2, 0), (3, 0), (3, 1), (2, 0)]]]})
    spread = [(rng.uniform(-2, 3.2), rng.uniform(-2, 2)) for _ in range(2000)]
    points = [*spread, *ring, *hole, (0.0, 0.25), (0.5, 0.0), (0.0, 0.3), (2.5, 0.0), (2.75, 0.5), (3.0, 1.0)]

    def inside(x, y):
        odd = False
        for x1, y1, x2, y2 in geo.edges(area):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return odd

    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "i int, x double, y double")
    got = {r[0] for r in df.filter(geo.within(area, F.col("x"), F.col("y"))).select("i").collect()}
    assert got == {i for i, p in enumerate(points) if inside(*p)} and len(got) > 300
    assert len(geo.bands(area)) > 50 and spark.createDataFrame([(None, 0.0)], "x double, y double").filter(geo.within(area, F.col("x"), F.col("y"))).count() == 0
