"""The panorama client, the hub model and the overlay, with made packages in place of the public ones."""

import json
import sys
from contextlib import nullcontext
from types import ModuleType, SimpleNamespace

import numpy as np
import pytest

from panoquarry.__main__ import arguments
from panoquarry.functions.detector import Detector
from panoquarry.functions.pictures import draw_detections
from panoquarry.plans import runs
from panoquarry.sources import street_view


class Picture:
    def __init__(self, zoom):
        self.size, self.saved = (512 << zoom, 256 << zoom), None

    def convert(self, mode):
        return np.full((*self.size[::-1], 3), 7, dtype=np.uint8)

    def save(self, path):
        self.saved = path


class Pen:
    def __init__(self):
        self.drawn = []

    def ellipse(self, box, **how):
        self.drawn.append(("ring", box, how["width"]))

    def text(self, place, said, **how):
        self.drawn.append(("text", place, said))


def answer(n_sizes):
    size = lambda x, y: SimpleNamespace(x=x, y=y)
    place = SimpleNamespace(id="next", address=[SimpleNamespace(value="Mill Lane")])
    return SimpleNamespace(
        id="here", source="scout", date=SimpleNamespace(year=2016, month=3, day=1), image_sizes=[size(512 << i, 256 << i) for i in range(n_sizes)], tile_size=size(512, 512), heading=0.5, pitch=None, roll=0.0,
        copyright_message=None, historical=[SimpleNamespace(id="old", date=None)], links=[SimpleNamespace(pano=place, direction=1.5), SimpleNamespace(pano=SimpleNamespace(id="far", address=None), direction=2.5)],
    )


@pytest.fixture()
def client(monkeypatch):
    asked = []
    view = SimpleNamespace(
        get_coverage_tile=lambda x, y: [SimpleNamespace(id=f"{x}-{y}", lat=1.0, lon=2.0)], find_panorama_by_id=lambda pid: None if pid == "gone" else answer(int(pid)),
        get_panorama=lambda found, zoom: asked.append(zoom) or Picture(zoom),
    )
    package = ModuleType("streetlevel")
    package.streetview = view
    monkeypatch.setitem(sys.modules, "streetlevel", package)
    return asked


def test_metadata(client):
    assert street_view.coverage(3, 4) == [("3-4", 1.0, 2.0)] and street_view.metadata("gone") is None
    about = street_view.metadata("2")
    assert about["date"] == {"year": 2016, "month": 3} and about["image_sizes"][-1] == {"x": 1024, "y": 512} and about["pitch"] is None
    assert about["historical"] == [{"id": "old", "date": None}]
    assert about["links"] == [{"pano_id": "next", "direction": 1.5, "address": [{"value": "Mill Lane"}]}, {"pano_id": "far", "direction": 2.5, "address": []}]


def test_pictures(client):
    for sizes, zoom in ((1, 0), (3, 2), (6, 3)):
        assert street_view.image(street_view.metadata(str(sizes))).shape == (256 << zoom, 512 << zoom, 3)
    assert street_view.image(street_view.metadata("0")) is None and client == [0, 2, 3]
    assert street_view.fetch("5").size == (4096, 2048)
    with pytest.raises(LookupError):
        street_view.fetch("gone")


def test_hub_model(monkeypatch):
    told = []

    class Tensor:
        def __init__(self, values):
            self.values = values

        def to(self, device):
            told.append(device)
            return self

        def squeeze(self):
            return Tensor(self.values.squeeze())

        def cpu(self):
            return self

        def numpy(self):
            return self.values

    class Model:
        def to(self, device):
            return self

        def eval(self):
            return lambda batch: Tensor((batch.values[:, :1] > 0).astype(np.float32))

    torch = ModuleType("torch")
    torch.cuda, torch.backends = SimpleNamespace(is_available=lambda: False), SimpleNamespace(mps=SimpleNamespace(is_available=lambda: True))
    torch.no_grad, torch.from_numpy = nullcontext, Tensor
    hub = ModuleType("transformers")
    hub.AutoModel = SimpleNamespace(from_pretrained=lambda name, trust_remote_code: told.append((name, trust_remote_code)) or Model())
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "transformers", hub)
    picture = np.zeros((20, 40, 3), dtype=np.uint8)
    picture[8, 30] = 255
    assert Detector("made-hub", street_view.HubModel("a/b"), distance=2, size=None)(picture) == [(0.75, 0.4, 1.0)]
    assert told == [("a/b", False), "mps"]
    assert street_view.services().detect is None and street_view.services("a/b").detect.name == "a/b"


def test_overlay(spark, tmp_path):
    line = lambda pid, *found: json.dumps({"pano": {"panorama_id": pid, "width": 1000, "height": 500}, "detections": [dict(zip(("x_normalized", "y_normalized", "confidence"), d, strict=True)) for d in found]})
    path = tmp_path / "results.jsonl"
    path.write_text("\n".join([line("bare"), "", line("first", (0.5, 0.25, 0.875), (0.0, 1.0, 0.6)), line("second", (0.1, 0.1, 0.9))]) + "\n")
    asked, pen, picture = [], Pen(), Picture(1)
    report = runs.overlay(spark, str(tmp_path), lambda pid: asked.append(pid) or picture, "out.png", lambda p: pen)
    # a picture of 1024 x 512: rings of radius 40 around (512, 128) and (0, 512)
    assert report.counts == {"detections": 2} and asked == ["first"] and picture.saved == "out.png"
    assert pen.drawn == [("ring", [472, 88, 552, 168], 8), ("text", (557, 88), "0.88"), ("ring", [-40, 472, 40, 552], 8), ("text", (45, 472), "0.60")]
    path.write_text(line("bare") + "\n")
    assert runs.overlay(spark, str(path), asked.append, "none.png").counts == {"detections": 0} and asked == ["first"]
    draw_detections(None, (10, 10), [])


def test_arguments():
    a = arguments(["label", "area.json", "run", "--hub-model", "a/b", "--model-id", "m"])
    assert (a.hub_model, a.model_id, a.trust_remote_code, a.services) == ("a/b", "m", False, None)
    assert arguments(["scan", "area.json", "run"]).services is None and arguments(["overlay", "run", "o.png"]).out == "o.png"
    with pytest.raises(SystemExit):
        arguments(["label", "area.json", "run"])
