"""Pictures of a gallery as JPEG files, save for network.rendered; detections drawn on a picture."""

from __future__ import annotations

import os

#: The width of a whole panorama in the viewer, qualities of close-ups and wholes, and the
#: number by which picture libraries know the bilinear filter.
DISPLAY_WIDTH, CLOSE_QUALITY, WHOLE_QUALITY, BILINEAR = 1600, 85, 80, 2


class Jpeg:
    """Saves into folder, which workers must share. A picture has crop, resize, convert and save."""

    def __init__(self, folder: str, width: int = DISPLAY_WIDTH):
        self.folder, self.width = folder, width

    def __call__(self, picture, box: tuple[int, int, int, int] | None, name: str) -> None:
        os.makedirs(self.folder, exist_ok=True)
        part = picture.crop(box) if box else picture.resize((self.width, self.width // 2), BILINEAR)
        part.convert("RGB").save(os.path.join(self.folder, name), quality=CLOSE_QUALITY if box else WHOLE_QUALITY)


#: Radius and width of the ring around a detection, and how far beside it its confidence stands.
RADIUS, RING_WIDTH, BESIDE = 40, 8, 5
RED = (255, 0, 0)


def draw_detections(pen, size: tuple[int, int], detections: list[tuple[float, float, float]]) -> None:
    """A ring around each detection (normalised x and y, confidence) of a picture of that size, and its
    confidence. pen has ellipse and text, as the drawing tools of picture libraries do."""
    for x, y, confidence in detections:
        px, py = x * size[0], y * size[1]
        pen.ellipse([px - RADIUS, py - RADIUS, px + RADIUS, py + RADIUS], outline=RED, width=RING_WIDTH)
        pen.text((px + RADIUS + BESIDE, py - RADIUS), f"{confidence:.2f}", fill=RED)


def pillow_pen(picture):
    from PIL import ImageDraw

    return ImageDraw.Draw(picture)
