"""Comparison of line graphs: node assignment, segment matching and transforms.

Nodes: image_id, node_id, kind, x, y.  Segments: image_id, seg_id, from_node, to_node, x0, y0, x1, y1.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stipple.functions import kernels
from stipple.functions.scalars import normalized_degrees, rotated

KINDS = ("crossing", "boundary")


def segment_geometry(segments: DataFrame) -> DataFrame:
    """Length, angle in degrees and midpoint from the whole end points."""
    dx, dy = (F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double")
    return segments.withColumns({"size": F.sqrt(dx * dx + dy * dy), "angle_deg": F.degrees(F.atan2(dy, dx)), "mx": (F.col("x0") + F.col("x1")) / 2.0, "my": (F.col("y0") + F.col("y1")) / 2.0})


def node_degrees(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """How many segment ends each node has; 0 for one without."""
    ends = segments.select("image_id", F.explode(F.array("from_node", "to_node")).alias("node_id")).groupBy("image_id", "node_id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(ends, ["image_id", "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def translations(nodes: DataFrame, ref: int) -> DataFrame:
    """For each target image and kind, the move from the reference's mean point to the target's; 0 if one has none."""
    means = nodes.filter(F.col("kind").isin(*KINDS)).groupBy("image_id", "kind").agg(F.avg("x").alias("ax"), F.avg("y").alias("ay"))
    own = means.filter(F.col("image_id") == ref).select("kind", F.col("ax").alias("rx"), F.col("ay").alias("ry"))
    out = means.filter(F.col("image_id") != ref).join(F.broadcast(own), "kind", "left")
    return out.select("image_id", "kind", F.coalesce(F.col("ax") - F.col("rx"), F.lit(0.0)).alias("tx"), F.coalesce(F.col("ay") - F.col("ry"), F.lit(0.0)).alias("ty"))


def node_costs(degrees: DataFrame, moves: DataFrame, ref: int, penalty: float = 20.0) -> DataFrame:
    """Costs of pairing each node of the reference with each of a target, within a kind.

    The reference's nodes, a few dozen of one graph, are broadcast; targets stay where they are.
    """
    own = degrees.filter(F.col("image_id") == ref).select("kind", F.col("node_id").alias("ref_node"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("degree").alias("rd"))
    both = degrees.filter(F.col("image_id") != ref).join(moves, ["image_id", "kind"]).join(F.broadcast(own), "kind")
    d = F.sqrt((F.col("rx") + F.col("tx") - F.col("x")) ** 2 + (F.col("ry") + F.col("ty") - F.col("y")) ** 2)
    return both.select("image_id", "kind", "ref_node", F.col("node_id").alias("tgt_node"), (d + penalty * F.abs(F.col("rd") - F.col("degree"))).alias("cost"))


def assign_nodes(costs: DataFrame) -> DataFrame:
    """The cheapest pairing of nodes for each target and kind; what is left over stays unpaired.

    An exact solver in O(n^3), so that node counts aren't limited.  Rows and columns are in the order of their ids.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="ref_node", columns="tgt_node", values="cost")
        order = lambda names: sorted(names, key=lambda n: (len(n), n))
        table = table.loc[order(table.index), order(table.columns)]
        pairs = kernels.assignment(table.to_numpy())
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "kind": pdf["kind"].iloc[0], "ref_node": [table.index[a] for a, _ in pairs], "tgt_node": [table.columns[b] for _, b in pairs], "cost": [float(table.iloc[a, b]) for a, b in pairs]})

    return costs.groupBy("image_id", "kind").applyInPandas(run, "image_id long, kind string, ref_node string, tgt_node string, cost double")


def match_nodes(nodes: DataFrame, segments: DataFrame, ref: int, penalty: float = 20.0) -> DataFrame:
    return assign_nodes(node_costs(node_degrees(nodes, segments), translations(nodes, ref), ref, penalty))


def segment_lookup(segments: DataFrame) -> DataFrame:
    """One segment for each unordered pair of nodes: the last."""
    a, b = F.least("from_node", "to_node"), F.greatest("from_node", "to_node")
    last = F.row_number().over(Window.partitionBy("image_id", a, b).orderBy(F.length("seg_id").desc(), F.col("seg_id").desc()))
    return segments.withColumn("a", a).withColumn("b", b).withColumn("last", last).filter("last = 1").drop("last")


def match_segments(segments: DataFrame, matches: DataFrame, ref: int) -> DataFrame:
    """Segments of the reference with those of each target between the matched nodes; ends keep their direction."""
    own = segment_geometry(segments.filter(F.col("image_id") == ref)).select(*[F.col(c).alias(f"ref_{c}") for c in ("seg_id", "from_node", "to_node", "size", "angle_deg", "mx", "my")])
    mapped = matches.select("image_id", F.col("ref_node").alias("ref_from_node"), F.col("tgt_node").alias("f"))
    to = matches.select("image_id", F.col("ref_node").alias("ref_to_node"), F.col("tgt_node").alias("t"))
    ends = mapped.join(F.broadcast(own), "ref_from_node").join(to, ["image_id", "ref_to_node"])
    ends = ends.withColumn("a", F.least("f", "t")).withColumn("b", F.greatest("f", "t"))
    tgt = segment_geometry(segment_lookup(segments.filter(F.col("image_id") != ref)))
    tgt = tgt.select("image_id", "a", "b", *[F.col(c).alias(f"tgt_{c}") for c in ("seg_id", "from_node", "to_node", "size", "angle_deg", "mx", "my")])
    return ends.join(tgt, ["image_id", "a", "b"]).drop("a", "b", "f", "t")


def transforms(matched: DataFrame) -> DataFrame:
    """Of each match: rotation, moves of the midpoint, the rigid move, and the ratio of lengths, to six places.

    Directions aren't turned round: swapped ends show as a rotation near 180 degrees.
    """
    turn = normalized_degrees(F.col("tgt_angle_deg") - F.col("ref_angle_deg"))
    rx, ry = rotated(F.col("ref_mx"), F.col("ref_my"), F.radians(turn))
    r = lambda c: F.bround(c, 6)
    xy = lambda a, b: F.struct(r(a).alias("x"), r(b).alias("y"))
    return matched.select(
        "image_id",
        F.col("ref_seg_id").alias("ref_segment"),
        F.col("tgt_seg_id").alias("target_segment"),
        "ref_from_node",
        "ref_to_node",
        F.col("tgt_from_node").alias("target_from_node"),
        F.col("tgt_to_node").alias("target_to_node"),
        r(turn).alias("rotation_deg"),
        xy(F.col("tgt_mx") - F.col("ref_mx"), F.col("tgt_my") - F.col("ref_my")).alias("translation_midpoint_xy"),
        xy(F.col("tgt_mx") - rx, F.col("tgt_my") - ry).alias("rigid_translation_xy"),
        r(F.col("ref_size")).alias("length_ref"),
        r(F.col("tgt_size")).alias("length_target"),
        r(F.col("tgt_size") / F.greatest("ref_size", F.lit(1e-9))).alias("length_ratio"),
        xy(F.col("ref_mx"), F.col("ref_my")).alias("midpoint_ref"),
        xy(F.col("tgt_mx"), F.col("tgt_my")).alias("midpoint_target"),
        r(F.col("ref_angle_deg")).alias("angle_ref_deg"),
        r(F.col("tgt_angle_deg")).alias("angle_target_deg"),
    )


def comparison_documents(nodes: DataFrame, segments: DataFrame, ref: int, penalty: float = 20.0) -> DataFrame:
    """One document for each target: counts, the map of nodes, and the matches in the order of their ids as text."""
    matches = match_nodes(nodes, segments, ref, penalty)
    moved = transforms(match_segments(segments, matches, ref))
    count = lambda df, name: df.groupBy("image_id").agg(F.count(F.lit(1)).alias(name))
    own_n, own_s = nodes.filter(F.col("image_id") == ref).count(), segments.filter(F.col("image_id") == ref).count()
    maps = matches.groupBy("image_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ref_node", "tgt_node")))).alias("node_mapping"), F.count(F.lit(1)).alias("matched_node_count"))
    cols = [c for c in moved.columns if c != "image_id"]
    lists = moved.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("segment_matches"), F.count(F.lit(1)).alias("matched_segment_count"))
    out = count(nodes.filter(F.col("image_id") != ref), "target_node_count").join(count(segments, "target_segment_count"), "image_id", "left").join(maps, "image_id", "left").join(lists, "image_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("image_id", F.lit(own_n).alias("reference_node_count"), zero("target_node_count"), F.lit(own_s).alias("reference_segment_count"), zero("target_segment_count"), zero("matched_node_count"), zero("matched_segment_count"), "node_mapping", "segment_matches")

