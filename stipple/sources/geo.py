"""Geometry and comparison documents as JSON, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GEO = (
    "source string, width long, height long, inner_rect array<long>, line_count long, node_count long, segment_count long, "
    "lines array<struct<id:long,family:long,origin:array<double>,direction:array<double>,support_count:long,support_length:double>>, "
    "nodes array<struct<id:string,kind:string,point:array<long>,line_index:long>>, "
    "segments array<struct<id:string,line_index:long,from:string,to:string,length:double,black_ratio:double,points:array<array<long>>>>"
)


def read_geo(spark: SparkSession, path: str) -> DataFrame:
    """Geometry documents, one for each file: image_id follows the order of the paths.

    Absent lists are empty, an absent rect is all zeros, an absent source is the path; without width or height the
    document fails when it is read.
    """
    raw = spark.read.schema(GEO).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    must = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit(f"no {c} in "), F.col("path")))).otherwise(F.col(c))
    empty = lambda c: F.coalesce(F.col(c), F.from_json(F.lit("[]"), raw.schema[c].dataType.simpleString()))
    # only paths are put in order, not the documents
    ids = raw.select("path").distinct().select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("image_id"))
    return raw.join(ids, "path").select("image_id", "path", F.coalesce("source", "path").alias("source"), must("width").alias("width"), must("height").alias("height"), F.coalesce("inner_rect", F.array(*[F.lit(0).cast("long")] * 4)).alias("inner_rect"), *[empty(c).alias(c) for c in ("lines", "nodes", "segments")])


def geo_nodes(docs: DataFrame) -> DataFrame:
    return docs.select("image_id", F.explode("nodes").alias("n")).select("image_id", F.col("n.id").alias("node_id"), "n.kind", F.col("n.point")[0].cast("double").alias("x"), F.col("n.point")[1].cast("double").alias("y"), "n.line_index")


def geo_segments(docs: DataFrame) -> DataFrame:
    p = F.col("s.points")
    return docs.select("image_id", F.explode("segments").alias("s")).select("image_id", F.col("s.id").alias("seg_id"), "s.line_index", F.col("s.from").alias("from_node"), F.col("s.to").alias("to_node"), "s.length", "s.black_ratio", p[0][0].alias("x0"), p[0][1].alias("y0"), p[1][0].alias("x1"), p[1][1].alias("y1"))


def geo_lines(docs: DataFrame) -> DataFrame:
    """Lines; extents aren't part of a document, so they are open."""
    return docs.select("image_id", F.explode("lines").alias("l")).select("image_id", F.col("l.id").alias("line_id"), "l.family", F.col("l.origin")[0].alias("ox"), F.col("l.origin")[1].alias("oy"), F.col("l.direction")[0].alias("dx"), F.col("l.direction")[1].alias("dy"), F.lit(float("-inf")).alias("tmin"), F.lit(float("inf")).alias("tmax"), "l.support_count", "l.support_length")


def geo_rects(docs: DataFrame) -> DataFrame:
    return docs.select("image_id", *[F.col("inner_rect")[k].alias(c) for k, c in enumerate(("left", "top", "right", "bottom"))])


def write_documents(docs: DataFrame, path: str) -> None:
    """One JSON object a line; writers run in parallel."""
    docs.write.mode("overwrite").json(path)


def to_json(docs: DataFrame) -> DataFrame:
    """Each document as indented JSON text, for single files."""
    return docs.select("image_id", F.to_json(F.struct(*[c for c in docs.columns if c != "image_id"]), {"pretty": "true", "ignoreNullFields": "false"}).alias("text"))
