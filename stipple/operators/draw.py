"""Pictures as relations: a list of shapes to draw (image_id, z, shape, x0, y0, x1, y1, color), rasterised on request.

Colours are BGR as 0xBBGGRR numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.functions import kernels

RED, GREEN, CYAN, WHITE = 0x0000FF, 0x00FF00, 0xFFFF00, 0xFFFFFF
PANEL_GAP, LEGEND = 120, 70


def palette(index: Column, n: int = 30) -> Column:
    """One of n colours by a rule: hues a golden angle apart, cyclic."""
    import colorsys

    table = []
    for k in range(n):
        r, g, b = colorsys.hsv_to_rgb(k * 0.61803398875 % 1.0, 0.75, 0.9)
        table.append(int(b * 255) << 16 | int(g * 255) << 8 | int(r * 255))
    return F.element_at(F.array(*map(F.lit, table)), (F.pmod(index, F.lit(n)) + 1).cast("int"))


def _shape(z: int, shape: str, x0, y0, x1, y1, color: Column) -> list[Column]:
    whole = lambda c: (F.rint(c) if isinstance(c, Column) else F.rint(F.col(c))).cast("long")
    return [F.lit(z).alias("z"), F.lit(shape).alias("shape"), whole(x0).alias("x0"), whole(y0).alias("y0"), whole(x1).alias("x1"), whole(y1).alias("y1"), color.alias("color")]


def segment_shapes(segments: DataFrame, color: Column | None = None) -> DataFrame:
    return segments.select("image_id", *_shape(1, "line", "x0", "y0", "x1", "y1", color if color is not None else F.lit(RED)))


def node_shapes(nodes: DataFrame) -> DataFrame:
    return nodes.select("image_id", *_shape(2, "dot", "x", "y", "x", "y", F.when(F.col("kind") == "crossing", GREEN).otherwise(CYAN)))


def rect_shapes(rects: DataFrame) -> DataFrame:
    return rects.select("image_id", *_shape(0, "rect", "left", "top", "right", "bottom", F.lit(WHITE)))


def result_shapes(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    return segment_shapes(segments).unionByName(node_shapes(nodes))


def outline_shapes(regions: DataFrame) -> DataFrame:
    """Regions' outlines in green, for overlays on photos."""
    n, p = F.size("simplified"), F.col("simplified")
    side = F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(p[i].alias("a"), p[(i + 1) % n].alias("b"))))
    return regions.select("image_id", side.alias("s")).select("image_id", *_shape(1, "line", F.col("s.a.x"), F.col("s.a.y"), F.col("s.b.x"), F.col("s.b.y"), F.lit(GREEN)))


def comparison_shapes(moved: DataFrame, segments: DataFrame, width: int, ref: int) -> DataFrame:
    """Two panels side by side, a matched pair of segments in one colour, and a line between their midpoints."""
    own = segments.filter(F.col("image_id") == ref).select(F.col("seg_id").alias("ref_segment"), *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    tgt = segments.select("image_id", F.col("seg_id").alias("target_segment"), "x0", "y0", "x1", "y1")
    both = moved.join(F.broadcast(own), "ref_segment").join(tgt, ["image_id", "target_segment"])
    color, right = palette(F.substring("ref_segment", 2, 9).cast("int")), width + PANEL_GAP
    down = lambda c: F.col(c) + LEGEND
    left = both.select("image_id", *_shape(1, "line", "rx0", down("ry0"), "rx1", down("ry1"), color))
    other = both.select("image_id", *_shape(1, "line", F.col("x0") + right, down("y0"), F.col("x1") + right, down("y1"), color))
    link = both.select("image_id", *_shape(0, "line", F.col("midpoint_ref.x"), F.col("midpoint_ref.y") + LEGEND, F.col("midpoint_target.x") + right, F.col("midpoint_target.y") + LEGEND, color))
    return left.unionByName(other).unionByName(link)


def rasterise(shapes: DataFrame, width: int, height: int) -> DataFrame:
    """One BGR picture for each image, shapes drawn by z."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((height, width, 3), np.uint8)
        for s in pdf.sort_values("z", kind="stable").itertuples():
            bgr = np.array([s.color >> 16 & 255, s.color >> 8 & 255, s.color & 255], np.uint8)
            if s.shape == "line":
                kernels.draw_line(out, (s.x0, s.y0), (s.x1, s.y1), bgr)
            elif s.shape == "dot":
                out[max(0, s.y0 - 3) : max(0, s.y0 + 4), max(0, s.x0 - 3) : max(0, s.x0 + 4)] = bgr
            else:
                for a, b in (((s.x0, s.y0), (s.x1, s.y0)), ((s.x1, s.y0), (s.x1, s.y1)), ((s.x1, s.y1), (s.x0, s.y1)), ((s.x0, s.y1), (s.x0, s.y0))):
                    kernels.draw_line(out, a, b, bgr)
        return pd.DataFrame([{"image_id": pdf["image_id"].iloc[0], "height": height, "width": width, "data": out.tobytes()}])

    return shapes.groupBy("image_id").applyInPandas(run, "image_id long, height int, width int, data binary")
