"""Images in and out: Spark's image source, names of files, and a PNG writer."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.functions import kernels

# Suffixes of images, and names of what the stages write.
SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")
ARTIFACTS = {
    "crop": "{stem}_crop.jpg",
    "crop_preview": "{stem}_preview.jpg",
    "holes": "{stem}_holes_bw.png",
    "holes_raw": "{stem}_threshold_raw.png",
    "holes_inverted": "{stem}_holes_bw_inverted.png",
    "holes_preview": "{stem}_holes_preview.png",
    "pattern_preview": "{stem}_pattern_preview.png",
    "instances": "{stem}_matrix_instances_bw.png",
    "line_preview": "{stem}_pattern_line_preview.png",
    "band_preview": "{stem}_pattern_band_preview.png",
    "boundary": "{stem}_matrix_boundary_bw.png",
    "boundary_band": "{stem}_matrix_boundary_band_bw.png",
    "signature": "{stem}_structure_signature_map.png",
    "geo_image": "geo_{stem}.jpg",
    "geo": "geo_{stem}.json",
    "comparison": "{ref}_vs_{tgt}.json",
    "comparison_image": "{ref}_vs_{tgt}_vis.png",
}


def artifact_name(kind: str, **parts: str) -> str:
    return ARTIFACTS[kind].format(**parts)


def has_image_suffix(path: Column) -> Column:
    return F.lower(path).rlike("(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$")


def read_images(spark: SparkSession, path: str, stem_suffix: str | None = None) -> DataFrame:
    """Images of a file or of a folder (not of those below it).

    Columns image_id (a 64-bit number made of the path, so that it stays the same wherever the image is read), origin,
    height, width, channels and data (BGR, row after row).  Rows have no order; ``orderBy("origin")`` gives one.  A file that can't be decoded fails when
    it is read.  stem_suffix keeps the files whose name, without its suffix, ends so.
    """
    raw = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", False).load(path)
    out = raw.select("image.*").filter(has_image_suffix(F.col("origin")))
    if stem_suffix:
        out = out.filter(F.regexp_replace("origin", r"\.[^./]*$", "").endswith(stem_suffix))
    bad = F.raise_error(F.concat(F.lit("not an image: "), F.col("origin")))
    return out.select(F.xxhash64("origin").alias("image_id"), "origin", F.when(F.col("height") < 0, bad).otherwise(F.col("height")).alias("height"), "width", F.col("nChannels").alias("channels"), "data")


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """Hole masks (*_holes_bw.png) as binary pixels, one byte each."""
    return to_gray(read_images(spark, path, "_holes_bw")).select("image_id", "origin", "height", "width", "data").transform(lambda df: _each(df, lambda a: (a > 127).astype(np.uint8) * 255))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Region masks: a single file, or those of a folder that end in _matrix_instances_bw."""
    return to_gray(read_images(spark, path, None if path.lower().endswith(SUFFIXES) else "_matrix_instances_bw"))


def _array(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, -1)


def to_gray(images: DataFrame) -> DataFrame:
    """Gray images; one of a single channel stays as it is."""

    def run(batches):
        for pdf in batches:
            pdf["data"] = [(a[..., 0] if (a := _array(r)).shape[2] == 1 else kernels.gray(a)).tobytes() for r in pdf.itertuples()]
            pdf["channels"] = 1
            yield pdf

    return images.mapInPandas(run, images.schema)


def _each(images: DataFrame, f) -> DataFrame:
    def run(batches):
        for pdf in batches:
            pdf["data"] = [f(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)).tobytes() for r in pdf.itertuples()]
            yield pdf

    return images.mapInPandas(run, images.schema)


def join_masks_with_rois(masks: DataFrame, rois: DataFrame) -> DataFrame:
    """Masks with the cropped photos that they belong to, by their names: an equi-join."""
    from stipple.functions.scalars import roi_path

    name = lambda c: F.element_at(F.split(c, "/"), -1)
    left = masks.withColumn("roi_name", name(roi_path(F.col("origin"))))
    return left.join(rois.select(name(F.col("origin")).alias("roi_name"), F.col("origin").alias("roi_origin"), F.col("data").alias("roi_data")), "roi_name")


def png(a: np.ndarray) -> bytes:
    """A PNG file of an array of bytes: gray (h, w) or BGR (h, w, 3)."""
    a = np.ascontiguousarray(a, np.uint8)
    kind = 0 if a.ndim == 2 else 2
    rows = a if a.ndim == 2 else a[..., ::-1].reshape(a.shape[0], -1)
    raw = np.concatenate([np.zeros((a.shape[0], 1), np.uint8), rows], axis=1).tobytes()

    def chunk(tag: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 3)) + chunk(b"IEND", b"")


def encode_png(images: DataFrame) -> DataFrame:
    """Rows (name, height, width, data) as PNG files (name, content)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"name": pdf["name"], "content": [png(a[..., 0] if (a := _array(r)).shape[2] == 1 else a) for r in pdf.itertuples()]})

    return images.select("name", "height", "width", "data").mapInPandas(run, "name string, content binary")


def write_masks(masks: DataFrame, path: str) -> None:
    """The main sink: Parquet, a binary cell for each mask, in folders by artifact."""
    masks.write.mode("overwrite").partitionBy("artifact").parquet(path)
