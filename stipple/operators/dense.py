"""Raster operators on whole images: one binary cell an image, NumPy kernels in Arrow batches.

Images: image_id, height, width, channels, data.  Narrow maps; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from stipple.functions import kernels
from stipple.plans.params import Centreline, Holes, Params, Roi

GRAY = "image_id long, height int, width int, data binary"


def _array(r) -> np.ndarray:
    a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1)
    return a[..., 0] if a.shape[2] == 1 else a


def _gray(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else kernels.gray(a)


def _images(images: DataFrame, f) -> DataFrame:
    def run(batches):
        for pdf in batches:
            out = [f(_array(r)) for r in pdf.itertuples()]
            yield pd.DataFrame({"image_id": pdf["image_id"], "height": [a.shape[0] for a in out], "width": [a.shape[1] for a in out], "data": [np.ascontiguousarray(a, np.uint8).tobytes() for a in out]})

    return images.select("image_id", "height", "width", "data").mapInPandas(run, GRAY)


def rescaled(images: DataFrame, scale: float) -> DataFrame:
    """Nearest-neighbour scaling; 1 leaves all as it is."""
    return images if scale == 1.0 else _images(images, lambda a: kernels.nearest_resize(a, max(1, int(np.rint(a.shape[0] * scale))), max(1, int(np.rint(a.shape[1] * scale)))))


def scaled_roi(roi: Roi, height: int, width: int) -> np.ndarray:
    """The region's corners for an image of another size, clipped to it."""
    p = np.array(roi.points, np.float64).reshape(4, 2) * (width / roi.base_width, height / roi.base_height)
    return np.clip(p, 0, (width - 1, height - 1))


def crops(images: DataFrame, roi: Roi) -> DataFrame:
    return _images(images, lambda a: kernels.crop_polygon(a, scaled_roi(roi, *a.shape[:2]))[0])


def hole_mask(gray: np.ndarray, p: Holes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The raw threshold, the mask of holes, and their centres."""
    raw = kernels.adaptive_threshold(gray, p.block, p.c)
    labels = kernels.label(kernels.close_(raw, kernels.ellipse(p.merge)))
    h, w = gray.shape
    keep = np.zeros(int(labels.max(initial=0)) + 1, bool)
    for s in kernels.stats(labels):
        short, long = max(1, min(s["width"], s["height"])), max(s["width"], s["height"])
        ok = p.min_area <= s["area"] <= p.max_area and long / short <= p.max_aspect and s["area"] / max(1, s["width"] * s["height"]) >= p.min_fill
        at_edge = s["left"] == 0 or s["top"] == 0 or s["left"] + s["width"] == w or s["top"] + s["height"] == h
        keep[s["label"]] = ok and not (p.discard_border and at_edge)
    mask = kernels.open_(raw & keep[labels], kernels.ellipse(p.clean))
    centres = np.array([(s["cx"], s["cy"]) for s in kernels.stats(kernels.label(mask))]).reshape(-1, 2)
    return raw, mask, centres


def holes(images: DataFrame, p: Holes) -> DataFrame:
    """For each image: raw and mask (binary), inverse and preview masks, and the centres as an array of points."""
    ddl = "image_id long, height int, width int, raw binary, mask binary, inverse binary, preview binary, centres array<struct<x:double,y:double>>"

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                g = _gray(_array(r))
                raw, mask, centres = hole_mask(g, p)
                as_bytes = lambda m: (m.astype(np.uint8) * 255).tobytes()
                rows.append((r.image_id, r.height, r.width, as_bytes(raw), as_bytes(mask), as_bytes(~mask), np.where(mask, np.uint8(255), g).tobytes(), [{"x": float(x), "y": float(y)} for x, y in centres]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ddl.split(", ")])

    return images.select("image_id", "height", "width", "data").mapInPandas(run, ddl)


def centrelines(masks: DataFrame, p: Centreline) -> DataFrame:
    """Centreline masks of region masks."""
    return _images(masks, lambda a: kernels.centreline(_gray(a), p.scale, p.min_radius, p.max_radius, p.probe, p.angles, p.reconnect).astype(np.uint8) * 255)


def thinned(masks: DataFrame) -> DataFrame:
    return _images(masks, lambda a: kernels.thin(_gray(a) > 127).astype(np.uint8) * 255)


def morphology(masks: DataFrame, what: str, k: int, shape: str = "ellipse") -> DataFrame:
    f = {"dilate": kernels.dilate, "erode": kernels.erode, "open": kernels.open_, "close": kernels.close_}[what]
    return _images(masks, lambda a: f(_gray(a), kernels.element(k, shape)))


def hough(masks: DataFrame, p: Params) -> DataFrame:
    """Straight runs of centreline masks: image_id, seg_no, x1, y1, x2, y2."""
    g = p.geometry

    def run(batches):
        for pdf in batches:
            rows = [(r.image_id, k, *s) for r in pdf.itertuples() for k, s in enumerate(kernels.hough_segments(_gray(_array(r)) > 127, g.votes, g.min_length, g.max_gap))]
            yield pd.DataFrame(rows, columns=["image_id", "seg_no", "x1", "y1", "x2", "y2"])

    return masks.select("image_id", "height", "width", "data").mapInPandas(run, "image_id long, seg_no long, x1 long, y1 long, x2 long, y2 long")


def pixels(images: DataFrame, above: int | None = None) -> DataFrame:
    """The pixel relation of gray images; only pixels above a value, if one is given."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                g = _gray(_array(r))
                ys, xs = np.nonzero(g > above) if above is not None else np.indices(g.shape).reshape(2, -1)
                yield pd.DataFrame({"image_id": r.image_id, "x": xs.astype(np.int64), "y": ys.astype(np.int64), "v": g[ys, xs].astype(np.int64)})

    return images.select("image_id", "height", "width", "data").mapInPandas(run, "image_id long, x long, y long, v long")
