"""Tile arithmetic and point-in-area tests as column expressions."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]


def tile_x(lon: Column, zoom: int) -> Column:
    return ((lon + 180.0) / 360.0 * float(1 << zoom)).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    return ((1.0 - F.asinh(F.tan(F.radians(lat))) / F.lit(math.pi)) / 2.0 * float(1 << zoom)).cast("int")


def tile_at(lat: float, lon: float, zoom: int) -> tuple[int, int]:
    n = float(1 << zoom)
    return int((lon + 180.0) / 360.0 * n), int((1.0 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2.0 * n)


def rings(geometry: dict) -> list[Ring]:
    """All rings of a bare Polygon or MultiPolygon."""
    parts = {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c}[geometry["type"]](geometry["coordinates"])
    return [[(float(p[0]), float(p[1])) for p in ring] for polygon in parts for ring in polygon]


def bbox(area: list[Ring]) -> tuple[float, float, float, float]:
    """West, south, east, north."""
    xs, ys = zip(*(p for ring in area for p in ring), strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def geometry_hash(geometry: dict) -> str:
    """SHA-256 of the canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(geometry, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def edges(area: list[Ring]) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for ring in area for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a != b]


def bands(area: list[Ring], most: int = 4096) -> list[list[tuple[float, float, float, float]]]:
    """The edges that reach into each of a number of equal latitude bands. Bands are halved until they
    hold no more than a few entries for each edge in all."""
    _, south, _, north = bbox(area)
    found = edges(area)
    n = max(1, min(most, len(found)))
    while True:
        out: list[list] = [[] for _ in range(n)]
        for e in found:
            low, high = (min(n - 1, int((y - south) / (north - south) * n)) if north > south else 0 for y in sorted((e[1], e[3])))
            for band in out[low : high + 1]:
                band.append(e)
        if n == 1 or sum(map(len, out)) <= 8 * len(found) + 64:
            return out
        n //= 2


def within(area: list[Ring], lon: Column, lat: Column, tolerance: float = 0.0) -> Column:
    """Strictly inside: an odd number of edges to the east is crossed, and no edge holds the point.
    Edges travel as one literal, so an area costs no join and no shuffle. The box comes first, so that
    far points cost two comparisons; the others meet only the edges of their latitude band. A point and
    the ends of edges get their band by one monotone formula, so no edge beside a point is missed."""
    west, south, east, north = bbox(area)
    banded = bands(area)
    # as text, which is parsed once: an expression for each number would take longer than the points
    entries = [[dict(zip(("x1", "y1", "x2", "y2"), e, strict=True)) for e in band] for band in banded]
    table = F.from_json(F.lit(json.dumps(entries)), "array<array<struct<x1:double,y1:double,x2:double,y2:double>>>")
    n = len(banded)
    at = F.least(F.lit(n - 1), ((lat - south) / (north - south) * n).cast("int")) if n > 1 else F.lit(0)

    def crossed(n: Column, e: Column) -> Column:
        over = (e["y1"] > lat) != (e["y2"] > lat)
        return n + F.when(over & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]), 1).otherwise(0)

    def holds(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lon - e["x1"])
        between = lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        return (F.abs(cross) <= tolerance) & between

    near = lon.between(west, east) & lat.between(south, north)
    beside = F.get(table, at)
    inside = (F.aggregate(beside, F.lit(0), crossed) % 2 == 1) & ~F.exists(beside, holds)
    return F.when(near, inside).otherwise(False)


def tiles(df: DataFrame, box: tuple[float, float, float, float], zoom: int = 17) -> DataFrame:
    """All tiles (x, y) that cover a box, for the one row of df."""
    west, south, east, north = box
    x0, y0 = tile_at(north, west, zoom)
    x1, y1 = tile_at(south, east, zoom)
    return df.select(F.explode(F.sequence(F.lit(x0), F.lit(x1))).alias("x")).select("x", F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("y"))
