"""A detector around a model that gives heat maps. Models are loaded once for each Python worker."""

from __future__ import annotations

import threading
from collections.abc import Callable

import numpy as np

from panoquarry.operators.peaks import peaks_of

#: What the model's input is normalised by, for red, green and blue.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: Fixed value: rows and columns of the model's input.
SIZE = (2048, 4096)
#: Devices, best first.
DEVICES = ("cuda", "mps", "cpu")
_loaded: dict[str, Callable] = {}
_loading = threading.Lock()


def best_device(available: Callable[[str], bool]) -> str:
    return next(d for d in DEVICES if d == DEVICES[-1] or available(d))


def two_to_one(picture: np.ndarray) -> np.ndarray:
    """At most twice as wide as high; what is beyond on the right goes."""
    return picture[:, : 2 * picture.shape[0]]


def _hat(old: int, new: int) -> np.ndarray:
    """Weights of old samples for each new one: a triangle around its place, as wide as samples lie apart."""
    wide = max(old / new, 1.0)
    places = (np.arange(new) + 0.5) * old / new - 0.5
    weights = np.clip(1 - np.abs(places[:, None] - np.arange(old)) / wide, 0, None).astype(np.float32)
    return weights / weights.sum(axis=1, keepdims=True)


def resized(picture: np.ndarray, size: tuple[int, int] | None = SIZE) -> np.ndarray:
    """The picture in size (rows, columns), bilinear, smoothed where it shrinks; as it is without a size."""
    if size is None or picture.shape[:2] == size:
        return picture
    tall = np.tensordot(_hat(picture.shape[0], size[0]), picture.astype(np.float32), 1)
    wide = np.einsum("cx,rxk->rck", _hat(picture.shape[1], size[1]), tall, optimize=True)
    return np.clip(np.rint(wide), 0, 255).astype(np.uint8)


def normalised(picture: np.ndarray) -> np.ndarray:
    """Bytes (rows, columns, 3) to floats (3, rows, columns)."""
    return ((picture.astype(np.float32) / 255 - np.float32(MEAN)) / np.float32(STD)).transpose(2, 0, 1)


class Detector:
    """detect for network.processed. load() gives a function from normalised pictures to a heat map;
    it runs in the worker, at its first picture, and stays there under name."""

    def __init__(self, name: str, load: Callable[[], Callable], distance: int = 10, threshold: float = 0.55, size: tuple[int, int] | None = SIZE):
        self.name, self.load, self.distance, self.threshold, self.size = name, load, distance, threshold, size

    def __call__(self, picture: np.ndarray) -> list[tuple[float, float, float]]:
        with _loading:
            if self.name not in _loaded:
                _loaded[self.name] = self.load()
        return peaks_of(_loaded[self.name](normalised(resized(two_to_one(picture), self.size))), self.distance, self.threshold)
