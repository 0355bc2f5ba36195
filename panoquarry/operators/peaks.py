"""Local maxima of heat maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def peaks(df: DataFrame, heat: Column, rows: int, cols: int, distance: int, threshold: float) -> DataFrame:
    """df with one row for each peak: r, c and value. A peak is above threshold, the largest within
    distance, and at least distance from the border. heat is a row-major array; a peak is found where
    the map is, without a join. Only pixels above threshold look at those around them."""
    near = F.sequence(F.lit(-distance), F.lit(distance))
    inside = lambda i: (F.floor(i / cols)).between(distance, rows - 1 - distance) & (i % cols).between(distance, cols - 1 - distance)
    above = F.filter(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda i: (heat[i].cast("double") > threshold) & inside(i))
    largest = lambda i: F.forall(near, lambda dr: F.forall(near, lambda dc: heat[i] >= heat[i + dr * cols + dc]))
    found = df.withColumn("i", F.explode(F.filter(above, largest)))
    return found.withColumns({"r": F.floor(F.col("i") / cols).cast("int"), "c": (F.col("i") % cols).cast("int"), "value": heat[F.col("i")]}).drop("i")


def peaks_of(heat: np.ndarray, distance: int = 10, threshold: float = 0.55) -> list[tuple[float, float, float]]:
    """The same of one array, for detectors: normalised x and y and the unclipped value, largest
    first. The search sees values within [0, 1]. Of equal peaks closer than distance the first one
    stays, and a map that is flat has none."""
    seen = np.clip(heat, 0, 1)
    wide = np.pad(seen, distance, constant_values=-np.inf)
    largest = np.lib.stride_tricks.sliding_window_view(wide, (2 * distance + 1, 2 * distance + 1)).max(axis=(2, 3))
    top = seen == largest
    if top.all():
        return []
    hit = top & (seen > threshold)
    hit[:distance], hit[-distance:], hit[:, :distance], hit[:, -distance:] = False, False, False, False
    r, c = np.nonzero(hit)
    kept: list[tuple[int, int]] = []
    for i in np.argsort(-seen[r, c], kind="stable"):
        if all(max(abs(r[i] - a), abs(c[i] - b)) >= distance for a, b in kept):
            kept.append((int(r[i]), int(c[i])))
    return [(b / heat.shape[1], a / heat.shape[0], float(heat[a, b])) for a, b in kept]
