"""The three programs on files: photos to hole masks and regions, region masks to line graphs, graphs to comparisons.

    python -m stipple.plans.program photos IN OUT [--preset small]
    python -m stipple.plans.program patterns IN OUT
    python -m stipple.plans.program compare IN OUT
"""

from __future__ import annotations

import argparse
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.plans import pipeline
from stipple.plans.params import LARGE, PRESETS, Params
from stipple.sources import geo, images


def write_files(files: DataFrame, folder: str) -> int:
    """Files (name, content) into a folder that all machines share; returns how many there are.

    Each is written by the task that has it, under another name first, so that a repeated task does no harm.
    """

    def run(batches):
        for pdf in batches:
            os.makedirs(folder, exist_ok=True)
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                part = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(part, "wb") as file:
                    file.write(content)
                os.replace(part, os.path.join(folder, name))
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def _stem(origin: str) -> F.Column:
    return F.regexp_replace(F.element_at(F.split(origin, "/"), -1), r"\.[^.]*$", "")


def photos(spark: SparkSession, path: str, out: str, params: Params = LARGE) -> int:
    """Hole masks of photos as PNG files, under the names of the stage, and regions as JSON lines in out/regions."""
    read = images.read_images(spark, path)
    names = read.select("image_id", _stem("origin").alias("stem"))
    got = pipeline.photo_to_regions(read.select("image_id", "height", "width", "data"), params)
    kinds = {"raw": "holes_raw", "mask": "holes", "inverse": "holes_inverted", "preview": "holes_preview"}
    parts = F.explode(F.array(*[F.struct(F.lit(images.ARTIFACTS[kind].replace("{stem}", "")).alias("suffix"), F.col(c).alias("data")) for c, kind in kinds.items()]))
    masks = got["holes"].select("image_id", "height", "width", parts.alias("p")).join(names, "image_id")
    files = images.encode_png(masks.select(F.concat("stem", "p.suffix").alias("name"), "height", "width", "p.data"))
    got["regions"].join(names, "image_id").write.mode("overwrite").json(f"{out}/regions")
    return write_files(files, out)


def patterns(spark: SparkSession, path: str, out: str, params: Params = LARGE) -> int:
    """A geometry document for each region mask, as geo_{stem}.json."""
    read = images.read_patterns(spark, path)
    names = read.select("image_id", "origin", _stem("origin").alias("stem"))
    docs = pipeline.regions_to_graph(read.select("image_id", "height", "width", "data"), params)["documents"]
    docs = docs.join(names.select("image_id", "origin"), "image_id").withColumn("source", F.col("origin")).drop("origin")
    name = F.concat(F.lit("geo_"), F.regexp_replace("stem", "_matrix_instances_bw$", ""), F.lit(".json"))
    return write_files(geo.to_json(docs).join(names, "image_id").select(name.alias("name"), F.col("text").alias("content")), out)


def comparisons(spark: SparkSession, path: str, out: str, params: Params = LARGE, ref: int = 0) -> int:
    """The document whose number in the order of paths is `ref` with every other one, as {ref}_vs_{tgt}.json."""
    docs = geo.read_geo(spark, path)
    names = docs.select("image_id", _stem("path").alias("stem"), F.element_at(F.split("path", "/"), -1).alias("file"))
    first = names.filter(F.col("image_id") == ref).first()
    if first is None:
        return 0
    found = pipeline.compare_graphs(geo.geo_nodes(docs), geo.geo_segments(docs), ref, params).join(names, "image_id")
    body = found.select("image_id", F.lit(first["file"]).alias("reference_file"), F.col("file").alias("target_file"), *[c for c in found.columns if c not in ("image_id", "stem", "file")])
    name = F.concat(F.lit(first["stem"] + "_vs_"), "stem", F.lit(".json"))
    return write_files(geo.to_json(body).join(names, "image_id").select(name.alias("name"), F.col("text").alias("content")), out)


PROGRAMS = {"photos": photos, "patterns": patterns, "compare": comparisons}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("program", choices=PROGRAMS)
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--preset", choices=PRESETS, default="large")
    own = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    print(f"{PROGRAMS[own.program](spark, own.input, own.output, PRESETS[own.preset])} files in {own.output}")


if __name__ == "__main__":
    main()
