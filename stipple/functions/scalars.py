"""Column expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column, digits: int = 0) -> Column:
    """Rounding with ties to even; to a whole number by rint, else to so many decimals."""
    return F.rint(c) if digits == 0 else F.bround(c, digits)


def odd_at_least(c: Column, least: int = 1) -> Column:
    """The next odd number from max(c, least) upwards."""
    v = F.greatest(c.cast("int"), F.lit(least))
    return F.when(v % 2 == 0, v + 1).otherwise(v)


def scaled_odd_kernel(size: Column, scale: float) -> Column:
    """A kernel size at another scale: odd and at least 3."""
    return odd_at_least(half_even(size * F.lit(scale)), 3)


def normalized_degrees(c: Column) -> Column:
    """An angle in (-180, 180]."""
    return F.lit(180.0) - F.pmod(F.lit(180.0) - c, F.lit(360.0))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def clip(c: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(c, low), high)


def gray(b: Column, g: Column, r: Column) -> Column:
    """0.114 B + 0.587 G + 0.299 R to the nearest whole number, in integer arithmetic."""
    return F.floor((b * 114 + g * 587 + r * 299 + 500) / 1000).cast("int")


def unit(angle: Column) -> tuple[Column, Column]:
    return F.cos(angle), F.sin(angle)


def rotated(x: Column, y: Column, radians: Column) -> tuple[Column, Column]:
    c, s = F.cos(radians), F.sin(radians)
    return c * x - s * y, s * x + c * y


def roi_path(mask_path: Column) -> Column:
    """The path of the cropped photo that a hole mask was made from."""
    stem = F.regexp_replace(mask_path, r"_holes_bw\.[^./]*$", "")
    return F.when(F.endswith(stem, F.lit("_crop")), F.concat(stem, F.lit(".jpg"))).otherwise(F.concat(stem, F.lit("_crop.jpg")))


def report_line(ref: Column, tgt: Column, rotation: Column, tx: Column, ty: Column, ratio: Column) -> Column:
    """One match as a line of the console report: 4, 2 and 4 decimals."""
    return F.format_string("%s -> %s: rot=%.4f deg, mid_t=(%.2f, %.2f), len_ratio=%.4f", ref, tgt, rotation, tx, ty, ratio)
