"""The three programs end to end: photos to regions, regions to line graphs, graphs to comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.operators import compare, dense, lines, pixels, points
from stipple.plans.params import LARGE, Params


def photo_to_regions(images: DataFrame, params: Params = LARGE) -> dict[str, DataFrame]:
    """Photos (image_id, height, width, data in BGR or gray) to hole masks, centres and regions."""
    cropped = dense.crops(dense.rescaled(images, params.image_scale), params.roi)
    found = dense.holes(cropped, params.holes)
    centres = found.select("image_id", F.posexplode("centres").alias("pid", "c")).select("image_id", F.col("pid").cast("long").alias("pid"), "c.x", "c.y")
    counts = centres.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4")
    centres_of = centres.join(counts.select("image_id"), "image_id", "left_semi")
    b = params.boundary
    spacings = points.spacing(points.nearest_neighbours(centres_of))
    members = points.point_components(points.annulus_edges(centres_of, spacings, b.min_r, b.max_r))
    regions = points.hulls(members, centres_of, spacings, b.min_points, b.hull_area, b.eps, b.eps_min, b.poly_eps)
    return {"crops": cropped, "holes": found, "centres": centres, "spacings": spacings, "components": members, "regions": regions}


def regions_to_graph(masks: DataFrame, params: Params = LARGE) -> dict[str, DataFrame]:
    """Region masks (image_id, height, width, data) to lines, nodes, segments and documents.

    A mask's dark pixels come as a relation, for the tests on black: of crossings, boundary nodes and segments.
    """
    g = params.geometry
    centre = dense.centrelines(masks, params.centreline)
    sizes = masks.select("image_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))
    px = dense.pixels(masks)
    rects = pixels.inner_rect(px.filter("v > 127"), sizes, inset=g.inset)
    black = px.filter("v < 128").join(sizes, "image_id").select("image_id", "x", "y", F.col("width").alias("w"), F.col("height").alias("h"))
    segs = lines.segment_features(dense.hough(centre, params), g.min_length)
    fitted = lines.fit_lines(segs.join(lines.cluster_segments(segs, g.rho), ["image_id", "seg_no"]))
    crossed = lines.crossings(fitted, rects, black, g.pad)
    nodes = lines.line_nodes(fitted, crossed, lines.rect_hits(fitted, rects), pad=g.pad, black=black, min_black=g.min_black)
    dark = lines.line_segments(nodes, g.min_segment, black, g.min_black)
    images = sizes.join(rects, "image_id").withColumn("source", F.lit(None).cast("string"))
    return {"centrelines": centre, "rects": rects, "lines": fitted, "nodes": nodes, "segments": dark, "documents": lines.geo_documents(images, fitted, nodes, dark)}


def compare_graphs(nodes: DataFrame, segments: DataFrame, ref: int, params: Params = LARGE) -> DataFrame:
    return compare.comparison_documents(nodes, segments, ref, params.compare.degree_penalty)
