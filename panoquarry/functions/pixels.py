"""From normalised places to pixels, and the statistics of reviews, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel(normalised: Column, size: Column) -> Column:
    """Rounded half to even, as an int."""
    return F.rint(normalised * size).cast("int")


def payload_labels(detections: Column, width: Column, height: Column) -> Column:
    return F.transform(detections, lambda d: F.struct(pixel(d["x_normalized"], width).alias("pano_x"), pixel(d["y_normalized"], height).alias("pano_y"), d["confidence"].alias("confidence")))


def crop_start(p: Column, size: int, crop: int) -> Column:
    return F.least(F.greatest(p - crop / 2, F.lit(0.0)), F.lit(float(size - crop))).cast("int")


def in_crop(p: Column, start: Column, crop: int) -> Column:
    return F.round((p - start) / float(crop), 4)


def zoom_level(image_sizes: Column, most: int = 3) -> Column:
    return F.least(F.lit(most), F.size(image_sizes) - 1)


def clamped_width(width: Column, height: Column) -> Column:
    """Panoramas are at most twice as wide as high."""
    return F.least(width, height * 2)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, within [0, 1]; (0, 1) without trials."""
    m = F.when(n > 0, n.cast("double"))
    p = successes / m
    scale = 1.0 + z * z / m
    centre = (p + z * z / (2.0 * m)) / scale
    margin = z * F.sqrt(p * (1.0 - p) / m + z * z / (4.0 * m * m)) / scale
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - margin)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), centre + margin)).otherwise(1.0)


def verdict_label(verdict: Column) -> Column:
    return F.when(verdict.isNull(), "unjudged").when(verdict == "true", "correct").when(verdict == "false", "incorrect").otherwise("unsure")


def runtime_hours(n: Column, seconds: float = 1.5) -> Column:
    return n * seconds / 3600.0


def on_download(normalised: Column, full: Column, download: Column) -> Column:
    """A place in full resolution, scaled to a smaller download."""
    return normalised * full * (download / full)


def pano_url(pid: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps/@?api=1&map_action=pano&pano="), pid)


def pano_title(pid: Column, date: Column, n: Column, group: Column) -> Column:
    return F.concat(pid, F.lit(" captured "), date, F.lit(" - "), n.cast("string"), F.lit(" detection(s) "), group)
