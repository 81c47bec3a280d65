"""Line graphs: directions, fitted lines, crossings, boundary nodes and segments, keyed by image_id."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stipple.operators.pixels import black_ratio


def hough_votes(mask: DataFrame, threshold: int = 80, step: int = 1) -> DataFrame:
    """Votes of set pixels (image_id, x, y) for (degree, distance); those with enough.  Combined before the shuffle."""
    turns = F.explode(F.array(*[F.struct(F.lit(k).alias("theta"), F.lit(math.cos(math.radians(k))).alias("c"), F.lit(math.sin(math.radians(k))).alias("s")) for k in range(0, 180, step)]))
    rho = F.floor(F.round(F.col("x") * F.col("a.c") + F.col("y") * F.col("a.s"), 9) + 0.5)
    return mask.select("image_id", "x", "y", turns.alias("a")).select("image_id", F.col("a.theta").alias("theta"), rho.alias("rho")).groupBy("image_id", "theta", "rho").agg(F.count(F.lit(1)).alias("votes")).filter(F.col("votes") >= threshold)


def hough_runs(mask: DataFrame, peaks: DataFrame, min_length: float, max_gap: float) -> DataFrame:
    """Gaps and islands along each peak's line: runs of pixels without a gap above max_gap, of min_length and more."""
    lines = peaks.select("image_id", "theta", "rho", F.radians("theta").alias("a"))
    near = mask.join(lines, "image_id").filter(F.abs(F.col("x") * F.cos("a") + F.col("y") * F.sin("a") - F.col("rho")) <= 1)
    t = near.withColumn("t", F.col("y") * F.cos("a") - F.col("x") * F.sin("a"))
    w = Window.partitionBy("image_id", "theta", "rho").orderBy("t", "x", "y")
    runs = t.withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w) > max_gap).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(w))
    by = runs.groupBy("image_id", "theta", "rho", "run").agg(F.min_by(F.struct("x", "y"), "t").alias("a"), F.max_by(F.struct("x", "y"), "t").alias("b"), (F.max("t") - F.min("t")).alias("size"), F.count(F.lit(1)).alias("n"))
    return by.filter(F.col("size") >= min_length).select("image_id", "theta", "rho", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"), "n")


def segment_features(segments: DataFrame, min_length: float = 160) -> DataFrame:
    """Length and direction modulo pi; short ones go, and all of an image that keeps fewer than two."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    out = segments.withColumn("length", F.sqrt(dx * dx + dy * dy)).withColumn("angle", F.pmod(F.atan2(dy.cast("double"), dx.cast("double")), F.lit(math.pi))).filter(F.col("length") >= min_length)
    n = F.count(F.lit(1)).over(Window.partitionBy("image_id"))
    return out.select("*", n.alias("n_segments")).filter("n_segments >= 2").drop("n_segments")


def families(angles: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Two families of directions by Lloyd's rounds on doubled angles: labels, and a unit direction for each.

    Seeds: the first segment and the one farthest from it.  Ties go to family 0; an empty family keeps its centre.
    """
    p = np.stack([np.cos(2 * angles), np.sin(2 * angles)], 1)
    centres = np.stack([p[0], p[int(np.argmax(((p - p[0]) ** 2).sum(1)))]])
    labels = np.zeros(len(p), int)
    for _ in range(rounds):
        d = ((p[:, None] - centres[None]) ** 2).sum(-1)
        labels = (d[:, 1] < d[:, 0]).astype(int)
        for k in (0, 1):
            if (labels == k).any():
                c = p[labels == k].mean(0)
                size = np.hypot(*c)
                if size > 0:
                    centres[k] = c / size
    half = np.arctan2(centres[:, 1], centres[:, 0]) / 2
    return labels, np.stack([np.cos(half), np.sin(half)], 1)


def rho_clusters(rho: np.ndarray, length: np.ndarray, limit: float = 55) -> np.ndarray:
    """One pass over sorted distances: a new cluster where the next is beyond `limit` of the current's weighted mean."""
    order = np.argsort(rho, kind="stable")
    out, cluster, weight, total = np.zeros(len(rho), int), -1, 0.0, 0.0
    for i in order:
        if cluster < 0 or abs(rho[i] - total / weight) > limit:
            cluster, weight, total = cluster + 1, 0.0, 0.0
        weight += length[i]
        total += rho[i] * length[i]
        out[i] = cluster
    return out


CLUSTERED = "image_id long, seg_no long, family long, cluster long, hx double, hy double"


def cluster_segments(segments: DataFrame, limit: float = 55) -> DataFrame:
    """Each segment's family, its cluster of distances there, and the family's direction; an image's are one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg_no", kind="stable")
        labels, directions = families(pdf["angle"].to_numpy())
        cluster = np.zeros(len(pdf), int)
        for k in (0, 1):
            own = labels == k
            if own.any():
                normal = (-directions[k, 1], directions[k, 0])
                rho = pdf["x1"].to_numpy()[own] * normal[0] + pdf["y1"].to_numpy()[own] * normal[1]
                cluster[own] = rho_clusters(rho, pdf["length"].to_numpy()[own], limit)
        return pd.DataFrame({"image_id": pdf["image_id"], "seg_no": pdf["seg_no"], "family": labels, "cluster": cluster, "hx": directions[labels, 0], "hy": directions[labels, 1]})

    return segments.select("image_id", "seg_no", "x1", "y1", "length", "angle").groupBy("image_id").applyInPandas(run, CLUSTERED)


def fit_lines(clustered: DataFrame) -> DataFrame:
    """A total-least-squares line for each (image_id, family, cluster) of segments with x1..y2, length, hx and hy.

    Pure aggregates over both endpoints of each segment; the sign follows the family's direction.  line_id counts an
    image's lines by family and cluster from 0.
    """
    key = ["image_id", "family", "cluster"]
    ends = clustered.select(*key, "hx", "hy", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("length").alias("l")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.lit(0.0).alias("l")))).alias("p"))
    x, y = F.col("p.x").cast("double"), F.col("p.y").cast("double")
    fit = ends.groupBy(*key).agg(F.avg(x).alias("ox"), F.avg(y).alias("oy"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cov"), F.first("hx").alias("hx"), F.first("hy").alias("hy"), (F.count(F.lit(1)) / 2).cast("long").alias("support_count"), F.sum("p.l").alias("support"))
    a = F.atan2(F.col("cov") * 2, F.col("vx") - F.col("vy")) / 2
    fit = fit.withColumn("cx", F.cos(a)).withColumn("cy", F.sin(a))
    sign = F.when(F.col("cx") * F.col("hx") + F.col("cy") * F.col("hy") < 0, -1.0).otherwise(1.0)
    fit = fit.withColumn("dx", F.col("cx") * sign).withColumn("dy", F.col("cy") * sign)
    t = (F.col("p.x") - F.col("ox")) * F.col("dx") + (F.col("p.y") - F.col("oy")) * F.col("dy")
    reach = ends.drop("hx", "hy").join(fit, key).groupBy(*key).agg(F.min(t).alias("tmin"), F.max(t).alias("tmax"))
    line = F.row_number().over(Window.partitionBy("image_id").orderBy("family", "cluster")) - 1
    return fit.join(reach, key).select("image_id", line.cast("long").alias("line_id"), "family", "ox", "oy", "dx", "dy", "tmin", "tmax", "support_count", F.bround("support", 2).alias("support_length"))


def _pair(lines: DataFrame, side: str) -> DataFrame:
    return lines.select("image_id", *[F.col(c).alias(f"{side}_{c}") for c in ("line_id", "family", "ox", "oy", "dx", "dy", "tmin", "tmax")])


def crossings(lines: DataFrame, rects: DataFrame, black: DataFrame | None = None, pad: float = 120) -> DataFrame:
    """Points where lines of two families meet, inside the rect and both padded extents, on black if that is given.

    black: image_id, x, y and the image's size w, h; points outside the image aren't tested.  Nodes C0, C1, ... by
    the lines' ids.
    """
    both = _pair(lines, "a").join(_pair(lines, "b"), "image_id").filter("a_line_id < b_line_id and a_family <> b_family")
    det = F.col("b_dx") * F.col("a_dy") - F.col("a_dx") * F.col("b_dy")
    wx, wy = F.col("b_ox") - F.col("a_ox"), F.col("b_oy") - F.col("a_oy")
    met = both.withColumn("det", det).filter(F.abs("det") >= 1e-6).withColumn("ta", F.try_divide(F.col("b_dx") * wy - wx * F.col("b_dy"), "det")).withColumn("tb", F.try_divide(F.col("a_dx") * wy - wx * F.col("a_dy"), "det"))
    met = met.withColumn("x", F.col("a_ox") + F.col("ta") * F.col("a_dx")).withColumn("y", F.col("a_oy") + F.col("ta") * F.col("a_dy"))
    inside = F.col("x").between(F.col("left"), F.col("right")) & F.col("y").between(F.col("top"), F.col("bottom"))
    near = lambda s: F.col(f"t{s}").between(F.col(f"{s}_tmin") - pad, F.col(f"{s}_tmax") + pad)
    met = met.join(rects, "image_id").filter(inside & near("a") & near("b"))
    if black is not None:
        size = black.groupBy("image_id").agg(F.first("w").alias("w"), F.first("h").alias("h"))
        spot = met.withColumn("px", F.rint("x").cast("long")).withColumn("py", F.rint("y").cast("long")).join(size, "image_id", "left")
        dark = black.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), F.lit(True).alias("dark"))
        within = F.col("px").between(0, F.col("w") - 1) & F.col("py").between(0, F.col("h") - 1)
        met = spot.join(dark, ["image_id", "px", "py"], "left").filter(~F.coalesce(within, F.lit(False)) | F.coalesce("dark", F.lit(False)))
    order = F.row_number().over(Window.partitionBy("image_id").orderBy("a_line_id", "b_line_id")) - 1
    return met.select("image_id", F.concat(F.lit("C"), order.cast("string")).alias("node_id"), order.cast("long").alias("n"), F.col("a_line_id").alias("line_a"), F.col("b_line_id").alias("line_b"), "x", "y", "ta", "tb")


def rect_hits(lines: DataFrame, rects: DataFrame) -> DataFrame:
    """Where lines meet the rect's sides, in the order left, right, top, bottom, without points within 2 of one before.

    ord tells the side.  Sides are met within a tolerance of 1; a line along a side doesn't meet it.
    """
    at = lines.join(rects, "image_id")

    def side(ord_: int, axis: str, bound: str, low: str, high: str) -> Column:
        other = "y" if axis == "x" else "x"
        t = F.try_divide(F.col(bound) - F.col(f"o{axis}"), F.col(f"d{axis}"))
        value = F.col(f"o{other}") + t * F.col(f"d{other}")
        ok = (F.abs(f"d{axis}") > 1e-6) & value.between(F.col(low) - 1, F.col(high) + 1)
        x, y = (F.col(bound).cast("double"), value) if axis == "x" else (value, F.col(bound).cast("double"))
        return F.when(ok, F.struct(F.lit(ord_).alias("ord"), x.alias("x"), y.alias("y"), t.alias("t")))

    hits = F.array(side(0, "x", "left", "top", "bottom"), side(1, "x", "right", "top", "bottom"), side(2, "y", "top", "left", "right"), side(3, "y", "bottom", "left", "right"))
    hits = F.filter(hits, lambda h: h.isNotNull())
    apart = lambda h, seen: ~F.exists(seen, lambda s: (s["x"] - h["x"]) ** 2 + (s["y"] - h["y"]) ** 2 < 4.0)
    kept = F.aggregate(hits, F.slice(hits, 1, 0), lambda seen, h: F.when(apart(h, seen), F.concat(seen, F.array(h))).otherwise(seen))
    return at.select("image_id", "line_id", F.explode(kept).alias("h")).select("image_id", "line_id", F.col("h.ord").alias("ord"), F.col("h.x").alias("x"), F.col("h.y").alias("y"), F.col("h.t").alias("t"))


def _dark(pairs: DataFrame, black: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The share of black between the two points of each pair.  black: image_id, x, y and the image's size w, h."""
    size = black.groupBy("image_id").agg(F.first("w").alias("w"), F.first("h").alias("h"))
    return black_ratio(pairs.join(size, "image_id", "left"), black, "w", "h", key=key)


def line_nodes(lines: DataFrame, crossing: DataFrame, hits: DataFrame, min_boundary: float = 10, pad: float = 120, black: DataFrame | None = None, min_black: float = 0.45) -> DataFrame:
    """Nodes on each line: crossings, and boundary nodes that pass.

    In the order of hits: on a line with nodes, boundary nodes just added included, a hit must be min_boundary or more
    from the nearest along the line, with a share of black of min_black or more between them if `black` is given; on a
    line without, it must lie in the padded extent.  Ids go on counting after the crossings, by line and hit.
    """
    on = crossing.select("image_id", F.explode(F.array(F.struct(F.col("line_a").alias("line_id"), F.col("ta").alias("t")), F.struct(F.col("line_b").alias("line_id"), F.col("tb").alias("t")))).alias("e"), "node_id", "n", "x", "y")
    on = on.select("image_id", F.col("e.line_id").alias("line_id"), "node_id", F.lit("crossing").alias("kind"), "n", "x", "y", F.col("e.t").alias("t"))
    # a node is known by its code: a crossing by its number, a hit by -1 - its side
    has = on.groupBy("image_id", "line_id").agg(F.sort_array(F.collect_list(F.struct(F.col("n"), F.col("t"), F.col("x"), F.col("y")))).alias("c"))
    has = has.select("image_id", "line_id", F.transform("c", lambda c: F.struct(c["t"].alias("t"), c["x"].alias("x"), c["y"].alias("y"), c["n"].cast("long").alias("code"))).alias("own"))
    code = -1 - F.col("ord").cast("long")
    todo = hits.groupBy("image_id", "line_id").agg(F.sort_array(F.collect_list(F.struct("ord", "t", "x", "y"))).alias("hits")).select("image_id", "line_id", F.transform("hits", lambda h: F.struct(h["t"].alias("t"), h["x"].alias("x"), h["y"].alias("y"), (-1 - h["ord"].cast("long")).alias("code"))).alias("hits"))
    both = todo.join(has, ["image_id", "line_id"], "left").join(lines.select("image_id", "line_id", "tmin", "tmax"), ["image_id", "line_id"])
    if black is not None:  # of each hit with all nodes that it may meet: crossings, and hits before it
        ends = on.select("image_id", "line_id", F.col("n").cast("long").alias("b"), F.col("x").alias("x1"), F.col("y").alias("y1"))
        ends = ends.unionByName(hits.select("image_id", "line_id", code.alias("b"), F.col("x").alias("x1"), F.col("y").alias("y1")))
        pairs = hits.select("image_id", "line_id", code.alias("a"), F.col("x").alias("x0"), F.col("y").alias("y0")).join(ends, ["image_id", "line_id"]).filter("b > a")
        dark = _dark(pairs, black, ("image_id", "line_id", "a", "b"))
        dark = dark.groupBy("image_id", "line_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("a", "b"), "black_ratio"))).alias("dark"))
        both = both.join(dark, ["image_id", "line_id"], "left")
    start = F.coalesce("own", F.slice("hits", 1, 0))

    def step(seen: Column, h: Column) -> Column:
        gaps = F.transform(seen, lambda s: F.abs(s["t"] - h["t"]))
        near = F.element_at(seen, F.greatest(F.array_position(gaps, F.array_min(gaps)).cast("int"), F.lit(1)))
        far = F.sqrt((near["x"] - h["x"]) ** 2 + (near["y"] - h["y"]) ** 2) >= min_boundary
        if black is not None:
            far = far & (F.element_at("dark", F.struct(h["code"].alias("a"), near["code"].alias("b"))) >= min_black)
        ok = F.when(F.size(seen) > 0, far).otherwise(h["t"].between(F.col("tmin") - pad, F.col("tmax") + pad))
        return F.when(ok, F.concat(seen, F.array(h))).otherwise(seen)

    done = both.select("image_id", "line_id", F.explode(F.filter(F.aggregate("hits", start, step), lambda s: s["code"] < 0)).alias("b"))
    count = crossing.groupBy("image_id").agg(F.count(F.lit(1)).alias("base"))
    order = F.row_number().over(Window.partitionBy("image_id").orderBy("line_id", F.col("b.code").desc())) - 1
    new = done.join(count, "image_id", "left").withColumn("n", (order + F.coalesce("base", F.lit(0))).cast("long"))
    new = new.select("image_id", "line_id", F.concat(F.lit("B"), F.col("n").cast("string")).alias("node_id"), F.lit("boundary").alias("kind"), "n", F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col("b.t").alias("t"))
    return on.unionByName(new)


def line_segments(nodes: DataFrame, min_segment: float = 80, black: DataFrame | None = None, min_black: float = 0.45, edge_segment: float = 35.0) -> DataFrame:
    """Segments between neighbouring nodes of a line: lead() over the line's order.

    At least min_segment long, or min(edge_segment, min_segment) if an end is on the boundary; with a share of black of
    min_black or more if `black` is given; of one pair of nodes the first of these; ids S0, S1, ... in line order,
    without gaps; lengths rounded to two places.
    """
    w = Window.partitionBy("image_id", "line_id").orderBy("t", "n")
    nxt = F.lead(F.struct("node_id", "kind", "x", "y")).over(w)
    pairs = nodes.withColumn("to", nxt).filter("to is not null").withColumn("pos", F.row_number().over(w))
    size = F.sqrt((F.col("x") - F.col("to.x")) ** 2 + (F.col("y") - F.col("to.y")) ** 2)
    edge = (F.col("kind") == "boundary") | (F.col("to.kind") == "boundary")
    pairs = pairs.withColumn("size", size).filter(F.col("size") >= F.when(edge, min(edge_segment, min_segment)).otherwise(min_segment))
    if black is not None:
        key = ("image_id", "line_id", "pos")
        dark = _dark(pairs.select(*key, F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("to.x").alias("x1"), F.col("to.y").alias("y1")), black, key)
        pairs = pairs.join(dark.withColumnRenamed("black_ratio", "black"), list(key)).filter(F.col("black") >= min_black)
    else:
        pairs = pairs.withColumn("black", F.lit(None).cast("double"))
    key = [F.least("node_id", "to.node_id"), F.greatest("node_id", "to.node_id")]
    first = F.row_number().over(Window.partitionBy("image_id", *key).orderBy("line_id", "pos"))
    pairs = pairs.withColumn("first", first).filter("first = 1")
    order = F.row_number().over(Window.partitionBy("image_id").orderBy("line_id", "pos")) - 1
    whole = lambda c: F.rint(c).cast("long")
    return pairs.select("image_id", F.concat(F.lit("S"), order.cast("string")).alias("seg_id"), F.col("line_id").alias("line_index"), F.col("node_id").alias("from_node"), F.col("to.node_id").alias("to_node"), F.bround("size", 2).alias("length"), F.bround("black", 3).alias("black_ratio"), whole("x").alias("x0"), whole("y").alias("y0"), whole(F.col("to.x")).alias("x1"), whole(F.col("to.y")).alias("y1"))


def geo_documents(images: DataFrame, lines: DataFrame, nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """One document for each image (image_id, source, width, height, left, top, right, bottom), as io.geo writes it."""
    ln = lines.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(F.col("line_id").alias("id"), "family", F.array(F.bround("ox", 3), F.bround("oy", 3)).alias("origin"), F.array(F.bround("dx", 6), F.bround("dy", 6)).alias("direction"), "support_count", "support_length"))).alias("lines"))
    once = nodes.groupBy("image_id", "node_id", "kind", "n").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.when(F.col("kind") == "boundary", F.min("line_id")).alias("line_index"))
    nd = once.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("n", F.col("node_id").alias("id"), "kind", F.array(F.rint("x").cast("long"), F.rint("y").cast("long")).alias("point"), "line_index"))).alias("nodes"))
    nd = nd.select("image_id", F.transform("nodes", lambda x: F.struct(x["id"].alias("id"), x["kind"].alias("kind"), x["point"].alias("point"), x["line_index"].alias("line_index"))).alias("nodes"))
    number = F.substring("seg_id", 2, 9).cast("int")
    sg = segments.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(number.alias("k"), F.col("seg_id").alias("id"), "line_index", F.col("from_node").alias("from"), F.col("to_node").alias("to"), "length", "black_ratio", F.array(F.array("x0", "y0"), F.array("x1", "y1")).alias("points")))).alias("segments"))
    sg = sg.select("image_id", F.transform("segments", lambda x: F.struct(*[x[c].alias(c) for c in ("id", "line_index", "from", "to", "length", "black_ratio", "points")])).alias("segments"))
    out = images.join(ln, "image_id", "left").join(nd, "image_id", "left").join(sg, "image_id", "left")
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    return out.select("image_id", "source", "width", "height", F.array("left", "top", "right", "bottom").alias("inner_rect"), count("lines").alias("line_count"), count("nodes").alias("node_count"), count("segments").alias("segment_count"), "lines", "nodes", "segments")
