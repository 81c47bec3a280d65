"""Raster operators over a pixel relation (image_id, x, y, v), or set pixels (image_id, x, y); all declarative.

Images are sparse: a pixel without a row has the value 0.  An image's size comes as columns or parameters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stipple.functions.kernels import element, offsets

KEY = ("image_id", "x", "y")


def threshold(pixels: DataFrame, above: float = 127) -> DataFrame:
    """A binary mask: v is 255 above the threshold, else 0."""
    return pixels.select(*KEY, F.when(F.col("v") > above, 255).otherwise(0).alias("v"))


def set_pixels(pixels: DataFrame, above: float = 127) -> DataFrame:
    return pixels.filter(F.col("v") > above).select(*KEY)


def binarise(pixels: DataFrame) -> DataFrame:
    """Two views that complement each other: black below 128, white above 127."""
    return pixels.select(*KEY, (F.col("v") < 128).alias("black"), (F.col("v") > 127).alias("white"))


def invert(pixels: DataFrame) -> DataFrame:
    return pixels.select(*KEY, (255 - F.col("v")).alias("v"))


def paint(pixels: DataFrame, holes: DataFrame, value: int = 255) -> DataFrame:
    """A preview: pixels of holes get one value."""
    marked = holes.select(*KEY, F.lit(True).alias("hole"))
    return pixels.join(marked, list(KEY), "left").select(*KEY, F.when(F.col("hole"), F.lit(value)).otherwise(F.col("v")).alias("v"))


def scale_points(points: DataFrame, base_width: int, base_height: int) -> DataFrame:
    """Points (x, y) given for a base size, for images of columns width and height, clipped to the image."""
    to = lambda c, size, base: F.least(F.greatest(F.col(c) * F.col(size) / F.lit(float(base)), F.lit(0.0)), F.col(size) - F.lit(1.0))
    return points.withColumn("sx", to("x", "width", base_width)).withColumn("sy", to("y", "height", base_height))


def in_polygon(x: Column, y: Column, polygon: list[tuple[int, int]]) -> Column:
    """Whether a cell lies in a closed polygon, its edges included."""
    inside, edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        cross = (x - x1) * (y2 - y1) * -1 + (y - y1) * (x2 - x1)
        edge = edge | ((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            hit = (y >= min(y1, y2)) & (y < max(y1, y2)) & ((cross > 0) if y2 > y1 else (cross < 0))
            inside = inside + hit.cast("int")
    return edge | (inside % 2 == 1)


def crop(pixels: DataFrame, polygon: list[tuple[int, int]]) -> DataFrame:
    """The polygon's bounding box, moved to the origin; 255 outside the polygon."""
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    if max(xs) - min(xs) < 1 or max(ys) - min(ys) < 1:
        raise ValueError("the region of interest is empty")
    box = pixels.filter(F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys)))
    v = F.when(in_polygon(F.col("x"), F.col("y"), polygon), F.col("v")).otherwise(255)
    return box.select("image_id", (F.col("x") - min(xs)).alias("x"), (F.col("y") - min(ys)).alias("y"), v.alias("v"))


def area_downscale(pixels: DataFrame, n: int, limit: int = 127) -> DataFrame:
    """Means of n x n cells over all n * n pixels, absent ones included as 0; dark where at most the limit."""
    cell = pixels.groupBy("image_id", F.floor(F.col("x") / n).alias("x"), F.floor(F.col("y") / n).alias("y")).agg(F.sum("v").alias("s"))
    mean = F.floor(F.col("s") / float(n * n) + 0.5)
    return cell.select("image_id", "x", "y", mean.alias("v"), (mean <= limit).alias("dark"))


def nearest_upscale(pixels: DataFrame, n: int) -> DataFrame:
    """Each pixel becomes n x n: a bounded expansion, without a shuffle."""
    steps = F.array(*[F.lit(k) for k in range(n)])
    wide = pixels.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    return wide.select("image_id", (F.col("x") * n + F.col("dx")).alias("x"), (F.col("y") * n + F.col("dy")).alias("y"), "v")


def _moved(mask: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    moves = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps]))
    return mask.select("image_id", "x", "y", moves.alias("m")).select("image_id", (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"))


def _within(width: int, height: int) -> Column:
    return F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)


def dilate(mask: DataFrame, width: int, height: int, k: int, shape: str = "ellipse") -> DataFrame:
    """Set pixels spread over a kernel; one aggregation, combined before its shuffle."""
    steps = [(-dx, -dy) for dx, dy in offsets(element(k, shape))]
    return _moved(mask, steps).filter(_within(width, height)).distinct()


def erode(mask: DataFrame, width: int, height: int, k: int, shape: str = "ellipse") -> DataFrame:
    """Pixels whose whole kernel, as far as it lies in the image, is set."""
    cells = offsets(element(k, shape))
    met = _moved(mask, [(-dx, -dy) for dx, dy in cells]).groupBy("image_id", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    need = sum((((F.col("x") + dx).between(0, width - 1)) & ((F.col("y") + dy).between(0, height - 1))).cast("int") for dx, dy in cells)
    return met.filter(_within(width, height) & (F.col("n") == need)).select(*KEY)


def open_(mask: DataFrame, width: int, height: int, k: int, shape: str = "ellipse") -> DataFrame:
    return dilate(erode(mask, width, height, k, shape), width, height, k, shape)


def close_(mask: DataFrame, width: int, height: int, k: int, shape: str = "ellipse") -> DataFrame:
    return erode(dilate(mask, width, height, k, shape), width, height, k, shape)


def _half_width(k: Column, dy: Column, shape: str) -> Column:
    """How far an odd kernel of size k reaches to each side in the row dy: the rule of kernels.element."""
    r = F.floor(k / 2)
    if shape == "rect":
        return r
    if shape == "cross":
        return F.when(dy == 0, r).otherwise(0)
    if shape == "ellipse":
        return F.when(r == 0, 0).otherwise(F.rint(r * F.sqrt(F.greatest(F.lit(0.0), 1 - dy * dy / (r * r)))))
    raise ValueError(f"unknown kernel shape {shape!r}")


def band_mask(lines: DataFrame, spacing: DataFrame, width: int, height: int, px: int = 0, ratio: float = 0.18, shape: str = "ellipse", frame: int = 0, style: str = "black_on_white") -> DataFrame:
    """Lines dilated to a band of px pixels, or of the image's spacing times a ratio, made odd; with a frame if asked.

    Returns the band's pixels with the value that the style gives them (0 on white, 255 on black).  Bands may have any
    width: each row of the kernel is a range of its own.
    """
    own = F.greatest(F.lit(1), F.rint(F.col("spacing") * ratio).cast("int")) if px <= 0 else F.lit(px)
    odd = F.when(own % 2 == 0, own + 1).otherwise(own)
    sized = lines.join(spacing.select("image_id", odd.alias("k")), "image_id")
    span = lambda n: F.explode(F.sequence(-n.cast("long"), n.cast("long")))
    tall = sized.select("image_id", "x", "y", "k", span(F.floor(F.col("k") / 2)).alias("dy"))
    moved = tall.select("image_id", "x", (F.col("y") - F.col("dy")).alias("y"), span(_half_width(F.col("k"), F.col("dy"), shape)).alias("dx"))
    out = moved.select("image_id", (F.col("x") - F.col("dx")).alias("x"), "y").filter(_within(width, height)).distinct()
    if frame:
        upto = lambda low, high: F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))
        rows = lines.select("image_id").distinct().select("image_id", F.explode(upto(0, height - 1)).alias("y"))
        sides = F.concat(upto(0, min(frame, width) - 1), upto(max(width - frame, 0), width - 1))
        whole = (F.col("y") < frame) | (F.col("y") >= height - frame)
        out = out.unionByName(rows.select("image_id", F.explode(F.when(whole, upto(0, width - 1)).otherwise(sides)).alias("x"), "y")).distinct()
    return out.withColumn("v", F.lit(0 if style == "black_on_white" else 255))


def gauss_threshold(pixels: DataFrame, weights: list[float], c: float) -> DataFrame:
    """Pixels at most the weighted mean around them less floor(c); a dense relation, edges repeated.

    Two passes of window functions, one along rows and one along columns.
    """
    r = len(weights) // 2

    def blur(v: str, along: str, across: str) -> Column:
        w = Window.partitionBy("image_id", across).orderBy(along)
        ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        total = F.lit(0.0)
        for k, weight in enumerate(weights):
            step = k - r
            moved = F.col(v) if step == 0 else F.coalesce(F.lag(v, -step).over(w), F.first(v).over(ends)) if step < 0 else F.coalesce(F.lead(v, step).over(w), F.last(v).over(ends))
            total = total + moved * weight
        return total

    rows = pixels.withColumn("h", blur("v", "x", "y"))
    mean = rows.withColumn("mean", F.rint(F.round(blur("h", "y", "x"), 9)))
    return mean.select(*KEY, "v", F.col("mean").cast("long").alias("mean"), (F.col("v") - F.col("mean") <= -math.floor(c)).alias("hole"))


def region_stats(labels: DataFrame) -> DataFrame:
    """Of each component (image_id, label): its box, area and centroid; pure aggregation."""
    return labels.groupBy("image_id", "label").agg(
        F.min("x").alias("left"),
        F.min("y").alias("top"),
        (F.max("x") - F.min("x") + 1).alias("width"),
        (F.max("y") - F.min("y") + 1).alias("height"),
        F.count(F.lit(1)).alias("area"),
        F.avg("x").alias("cx"),
        F.avg("y").alias("cy"),
    )


def region_features(stats: DataFrame) -> DataFrame:
    short = F.greatest(F.lit(1), F.least("width", "height"))
    long = F.greatest("width", "height")
    return stats.withColumn("aspect", long / short).withColumn("fill", F.col("area") / F.greatest(F.lit(1), F.col("width") * F.col("height")))


def region_filter(features: DataFrame, min_area: float = 6, max_area: float = 120, max_aspect: float = 1.8, min_fill: float = 0.5) -> DataFrame:
    return features.filter(F.col("area").between(min_area, max_area) & (F.col("aspect") <= max_aspect) & (F.col("fill") >= min_fill))


def drop_border(labels: DataFrame, width: int, height: int) -> DataFrame:
    """Components without a pixel on the image's edge."""
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)
    return labels.join(labels.filter(edge).select("image_id", "label").distinct(), ["image_id", "label"], "left_anti")


def back_project(labels: DataFrame, kept: DataFrame) -> DataFrame:
    """Pixels of the components that were kept."""
    return labels.join(kept.select("image_id", "label"), ["image_id", "label"], "left_semi")


def standalone_centres(features: DataFrame, width: int, height: int, strict: bool = False, min_area: float = 2, max_area: float = 200, max_aspect: float = 3.0, min_fill: float = 0.2) -> DataFrame:
    """Centres of components off the border; an image with fewer than four has a count to tell, or fails if strict."""
    inner = (F.col("left") > 0) & (F.col("top") > 0) & (F.col("left") + F.col("width") < width) & (F.col("top") + F.col("height") < height)
    kept = region_filter(features, min_area, max_area, max_aspect, min_fill).filter(inner)
    n = F.count(F.lit(1)).over(Window.partitionBy("image_id"))
    out = kept.select("image_id", "label", "cx", "cy", n.alias("centres"))
    if strict:
        out = out.withColumn("centres", F.when(F.col("centres") < 4, F.raise_error("fewer than four centres")).otherwise(F.col("centres")))
    return out


def exact_distance(mask: DataFrame, width: int, height: int, reach: int) -> DataFrame:
    """Distance of each set pixel to the nearest one in the image that isn't; null beyond `reach`."""
    steps = sorted(((dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1) if 0 < dx * dx + dy * dy <= reach * reach), key=lambda s: s[0] ** 2 + s[1] ** 2)
    moves = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps]))
    near = mask.select("image_id", "x", "y", moves.alias("m")).select("image_id", "x", "y", (F.col("x") + F.col("m.dx")).alias("u"), (F.col("y") + F.col("m.dy")).alias("w"), (F.col("m.dx") * F.col("m.dx") + F.col("m.dy") * F.col("m.dy")).alias("d2"))
    near = near.filter(F.col("u").between(0, width - 1) & F.col("w").between(0, height - 1))
    other = mask.select("image_id", F.col("x").alias("u"), F.col("y").alias("w"))
    free = near.join(other, ["image_id", "u", "w"], "left_anti").groupBy("image_id", "x", "y").agg(F.min("d2").alias("d2"))
    return mask.join(free, list(KEY), "left").select(*KEY, F.sqrt("d2").alias("d"))


def skeleton_candidates(skeleton: DataFrame, distance: DataFrame, low: float, high: float) -> DataFrame:
    return skeleton.join(distance.filter(F.col("d").between(low, high)), list(KEY)).select(*KEY, "d")


def two_sided_probe(candidates: DataFrame, dark: DataFrame, width: int, height: int, probe: float = 1.35, angles: int = 8, low: float = 5.0, high: float = 6.0) -> DataFrame:
    """Candidates with light on both sides at some angle, at a reach in proportion to their distance."""
    turn = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.cos(math.pi * k / angles)).alias("c"), F.lit(math.sin(math.pi * k / angles)).alias("s")) for k in range(angles)]))
    reach = F.least(F.greatest(F.col("d") * probe, F.lit(low)), F.lit(high))
    sides = F.explode(F.array(F.lit(1), F.lit(-1)))
    seen = candidates.select(*KEY, reach.alias("r"), turn.alias("a")).select(*KEY, "r", "a", sides.alias("s"))
    to = lambda c, f, top: F.least(F.greatest(F.col(c) + F.col("s") * F.rint(F.col("r") * F.col(f)), F.lit(0)), F.lit(top - 1)).cast("long")
    looked = seen.select(*KEY, F.col("a.k").alias("k"), to("x", "a.c", width).alias("u"), to("y", "a.s", height).alias("w"))
    hidden = dark.select("image_id", F.col("x").alias("u"), F.col("y").alias("w"), F.lit(1).alias("hidden"))
    by = looked.join(hidden, ["image_id", "u", "w"], "left").groupBy(*KEY, "k").agg(F.count("hidden").alias("n"))
    return by.filter("n = 0").select(*KEY).distinct()


def reconnect(candidates: DataFrame, seeds: DataFrame, width: int, height: int, k: int) -> DataFrame:
    """Candidates within a kernel of a seed."""
    return candidates.select(*KEY).join(dilate(seeds, width, height, k), list(KEY), "left_semi")


def inner_rect(white: DataFrame, sizes: DataFrame, share: float = 0.02, inset: int = 28) -> DataFrame:
    """The box of rows and columns with enough white, drawn in by `inset`; the whole image if nothing is left.

    sizes: image_id, width, height, one row for each image, so that images without white stay.
    """
    rows = white.groupBy("image_id", "y").agg(F.count(F.lit(1)).alias("n")).join(sizes, "image_id").filter(F.col("n") >= F.floor(F.col("width") * share)).groupBy("image_id").agg(F.min("y").alias("t"), F.max("y").alias("b"))
    cols = white.groupBy("image_id", "x").agg(F.count(F.lit(1)).alias("n")).join(sizes, "image_id").filter(F.col("n") >= F.floor(F.col("height") * share)).groupBy("image_id").agg(F.min("x").alias("l"), F.max("x").alias("r"))
    both = sizes.join(rows, "image_id", "left").join(cols, "image_id", "left")
    clip = lambda c, size: F.least(F.greatest(c, F.lit(0)), F.col(size) - 1)
    left, right = clip(F.col("l") + inset, "width"), clip(F.col("r") - inset, "width")
    top, bottom = clip(F.col("t") + inset, "height"), clip(F.col("b") - inset, "height")
    ok = (left < right) & (top < bottom)
    pick = lambda c, other: F.when(F.coalesce(ok, F.lit(False)), c).otherwise(other).cast("long")
    return both.select("image_id", pick(left, F.lit(0)).alias("left"), pick(top, F.lit(0)).alias("top"), pick(right, F.col("width") - 1).alias("right"), pick(bottom, F.col("height") - 1).alias("bottom"))


def black_ratio(segments: DataFrame, black: DataFrame, width: int | str, height: int | str, step: float = 6.0, key: tuple[str, ...] = ("image_id", "seg_id")) -> DataFrame:
    """The share of black among evenly spaced samples of segments (the key's columns, x0, y0, x1, y1).

    Samples outside the image count at its edge.  width and height are numbers, or name columns of the segments.
    """
    size = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    n = F.greatest(F.lit(2), F.ceil(size / step).cast("int"))
    spread = segments.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    of = lambda top: F.col(top) if isinstance(top, str) else F.lit(top)
    at = lambda a, b, top: F.least(F.greatest(F.rint(F.col(a) + (F.col(b) - F.col(a)) * (F.col("i") / (F.col("n") - 1))), F.lit(0.0)), of(top) - 1.0).cast("long")
    looked = spread.select(*key, at("x0", "x1", width).alias("x"), at("y0", "y1", height).alias("y"), size.alias("size"))
    hit = black.select(*KEY, F.lit(1).alias("hit"))
    by = looked.join(hit, list(KEY), "left").groupBy(*key).agg((F.count("hit") / F.count(F.lit(1))).alias("ratio"), F.first("size").alias("size"))
    return by.select(*key, F.when(F.col("size") < 1e-6, 0.0).otherwise(F.col("ratio")).alias("black_ratio"))


def components(mask: DataFrame) -> DataFrame:
    """8-connected components of set pixels; the label is the least y * 2^31 + x of the component.

    Union-find in one group for each image: an image is bounded, and iterating joins over it would cost far more.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code = np.sort((pdf["y"].to_numpy(np.int64) << 31) + pdf["x"].to_numpy(np.int64))
        root = np.arange(len(code))

        def find(a: int) -> int:
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        for step in (1, (1 << 31) - 1, 1 << 31, (1 << 31) + 1):
            at = np.searchsorted(code, code + step)
            hit = np.flatnonzero((at < len(code)) & (code[np.minimum(at, len(code) - 1)] == code + step))
            for a, b in zip(hit.tolist(), at[hit].tolist(), strict=True):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        own = code[[find(a) for a in range(len(code))]]
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "x": code & ((1 << 31) - 1), "y": code >> 31, "label": own})

    return mask.select(*[F.col(c).cast("long") for c in KEY]).distinct().groupBy("image_id").applyInPandas(run, "image_id long, x long, y long, label long")
