"""The hole stage over a folder that photos arrive in: stateless, so each file is one row in and one row out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.operators import dense
from stipple.plans.params import LARGE, Params

PHOTOS = "image_id long, height int, width int, data binary"


def hole_stream(spark: SparkSession, path: str, params: Params = LARGE) -> DataFrame:
    """A streaming relation of hole masks and centres from Parquet rows of photos."""
    photos = spark.readStream.schema(PHOTOS).parquet(path)
    return dense.holes(dense.crops(photos, params.roi), params.holes)


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what has arrived and stop; the checkpoint keeps what was done, so that no photo is done twice."""
    query = stream.withColumn("centre_count", F.size("centres")).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
