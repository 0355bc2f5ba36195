"""Services of the public packages ``streetlevel`` (coverage, metadata, pictures) and ``transformers``
(a model by its name on the hub). They are imported where they are called, in the workers, so that all
else works without them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np

from panoquarry.functions.detector import Detector, best_device
from panoquarry.plans.runs import Services

#: Fixed value: the finest level of detail that is asked for.
MOST_ZOOM = 3


def _client() -> Any:
    from streetlevel import streetview

    return streetview


def coverage(x: int, y: int) -> list[tuple[str, float, float]]:
    return [(p.id, p.lat, p.lon) for p in _client().get_coverage_tile(x, y)]


def _month(date: Any) -> dict | None:
    return date and {"year": date.year, "month": date.month}


def _size(size: Any) -> dict | None:
    return size and {"x": size.x, "y": size.y}


def metadata(pid: str) -> dict | None:
    """The fields of schemas.ABOUT, and the client's own answer, which image needs."""
    m = _client().find_panorama_by_id(pid)
    if m is None:
        return None
    links = [{"pano_id": n.pano.id, "direction": n.direction, "address": [{"value": a.value} for a in n.pano.address or []]} for n in m.links or []]
    plain = {k: getattr(m, k) for k in ("source", "heading", "pitch", "roll", "copyright_message")}
    old = [{"id": p.id, "date": _month(p.date)} for p in m.historical or []]
    return plain | {"date": _month(m.date), "image_sizes": [_size(z) for z in m.image_sizes or []], "tile_size": _size(m.tile_size), "historical": old, "links": links, "answer": m}


def _picture(answer: Any) -> Any:
    """The picture at the finest level that there is, at most MOST_ZOOM."""
    return _client().get_panorama(answer, zoom=min(MOST_ZOOM, len(answer.image_sizes) - 1))


def image(about: dict) -> np.ndarray | None:
    """Rows, columns and colours; None where the picture can't be had."""
    found = _picture(about["answer"]) if about["image_sizes"] else None
    return None if found is None else np.asarray(found.convert("RGB"))


def fetch(pid: str) -> Any:
    """The picture of an id, for galleries."""
    answer = _client().find_panorama_by_id(pid)
    if answer is None:
        raise LookupError("metadata unavailable")
    return _picture(answer)


class HubModel:
    """load for Detector: a model of the hub on the best device. Models that bring code of their own need
    trust, which runs that code in the workers."""

    def __init__(self, name: str, trust: bool = False):
        self.name, self.trust = name, trust

    def __call__(self) -> Callable[[np.ndarray], np.ndarray]:
        import torch
        from transformers import AutoModel

        there = {"cuda": torch.cuda, "mps": torch.backends.mps}
        device = best_device(lambda d: there[d].is_available())
        model = AutoModel.from_pretrained(self.name, trust_remote_code=self.trust).to(device).eval()

        def heat(picture: np.ndarray) -> np.ndarray:
            with torch.no_grad():
                return model(torch.from_numpy(np.ascontiguousarray(picture[None])).to(device)).squeeze().cpu().numpy()

        return heat


def services(model: str | None = None, trust: bool = False) -> Services:
    """Everything that a run calls; without a model it can only be scanned."""
    return Services(coverage, metadata, image, Detector(model, HubModel(model, trust)) if model else None)
