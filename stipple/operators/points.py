"""Point sets, proximity graphs and regions, keyed by image_id."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.functions import kernels


def _near(points: DataFrame, cells: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Pairs u, v of points in the same or neighbouring cells of the image's grid (column cell): an equi-join.

    Each point is also paired with itself.  asked: the points to take as u, all unless given.  Points are joined
    by merges: files of points are far smaller than their rows, and a join that trusts the files' size would send all
    points to the driver.
    """
    at = lambda c: F.floor(F.col(c) / F.col("cell"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = (points if asked is None else asked).hint("merge").join(cells, "image_id").select("image_id", F.col("pid").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"), at("x").alias("gx"), at("y").alias("gy"), around.alias("o"))
    left = left.select("image_id", "u", "ux", "uy", (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"))
    more = [c for c in cells.columns if c != "image_id"]
    right = points.hint("merge").join(cells, "image_id").select("image_id", F.col("pid").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"), *more, at("x").alias("gx"), at("y").alias("gy"))
    d = F.sqrt((F.col("ux") - F.col("vx")) ** 2 + (F.col("uy") - F.col("vy")) ** 2)
    return left.hint("merge").join(right, ["image_id", "gx", "gy"]).select("image_id", "u", "ux", "uy", "v", d.alias("d"), *more)


def nearest_neighbours(points: DataFrame, rounds: int = 40) -> DataFrame:
    """Distance of each point (image_id, pid, x, y) to its nearest other; none for a point that is alone.

    Cells of the size that four points in each would have; a distance up to a cell's size is exact, and only the
    points without one look again, in cells twice as large.  A round keeps the points that it leaves open beside
    those that are sure, so that no table of points is joined by its key.
    """
    wide, high = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    size = points.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), wide.alias("w"), high.alias("h"))
    size = size.filter("n > 1").withColumn("span", F.greatest("w", "h"))
    size = size.select("image_id", "span", F.greatest(F.sqrt(F.col("w") * F.col("h") / F.col("n")) * 2, F.col("span") / F.col("n"), F.lit(1e-9)).alias("cell"))
    asked, out, factor = None, None, 1.0
    for _ in range(rounds):
        cells = size.withColumn("cell", F.col("cell") * factor)
        other = F.min(F.when(F.col("u") != F.col("v"), F.col("d")))
        near = _near(points, cells, asked).groupBy("image_id", "u", "ux", "uy").agg(other.alias("d"), F.first("cell").alias("cell"), F.first("span").alias("span"))
        sure = F.coalesce(F.col("d") <= F.col("cell"), F.lit(False)) | (F.col("cell") >= F.col("span") * 1.5)  # beyond that all points of the image are met
        near = near.select("image_id", F.col("u").alias("pid"), F.col("ux").alias("x"), F.col("uy").alias("y"), "d", sure.alias("sure")).persist()
        found = near.filter("sure and d is not null").select("image_id", "pid", "d")
        out = found if out is None else out.unionByName(found)
        asked = near.filter("not sure").select("image_id", "pid", "x", "y")
        if asked.count() == 0:
            break
        factor *= 2
    return out.groupBy("image_id", "pid").agg(F.min("d").alias("d"))


def spacing(neighbours: DataFrame, strict: bool = False) -> DataFrame:
    """The median of each image's nearest distances; with strict, an image without any fails."""
    out = neighbours.groupBy("image_id").agg(F.median("d").alias("spacing"))
    if strict:
        out = out.withColumn("spacing", F.when(F.col("spacing").isNull(), F.raise_error("no nearest distance")).otherwise(F.col("spacing")))
    return out


def annulus_edges(points: DataFrame, spacings: DataFrame, low: float = 0.70, high: float = 1.55) -> DataFrame:
    """Undirected edges u < v with a distance from low to high spacings, both included."""
    least, most = F.col("spacing") * low, F.col("spacing") * high
    cells = spacings.select("image_id", F.greatest(most, F.lit(1e-9)).alias("cell"), least.alias("least"), most.alias("most"))
    return _near(points, cells).filter("u < v and d between least and most").select("image_id", "u", "v", "d")


def point_components(edges: DataFrame) -> DataFrame:
    """Components of each image's graph by union-find; points without an edge are in none.  comp_id: the least pid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, ends = np.unique(np.concatenate([pdf["u"], pdf["v"]]), return_inverse=True)
        root = np.arange(len(names))
        for a, b in zip(ends[: len(pdf)].tolist(), ends[len(pdf) :].tolist(), strict=True):
            a, b = kernels.find(root, a), kernels.find(root, b)
            root[max(a, b)] = min(a, b)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "comp_id": names[[kernels.find(root, a) for a in range(len(names))]], "pid": names})

    return edges.select("image_id", "u", "v").groupBy("image_id").applyInPandas(run, "image_id long, comp_id long, pid long")


def component_sizes(members: DataFrame, least: int = 4) -> DataFrame:
    return members.groupBy("image_id", "comp_id").agg(F.count(F.lit(1)).alias("n_points")).filter(F.col("n_points") >= max(3, least))


HULL = "image_id long, comp_id long, n_points long, area double, perimeter double, hull array<struct<x:long,y:long>>, simplified array<struct<x:long,y:long>>"


def hulls(members: DataFrame, points: DataFrame, spacings: DataFrame, least: int = 4, area_share: float = 0.20, eps: float = 0.10, eps_min: float = 1.0, poly_eps: float = 0.0035) -> DataFrame:
    """Regions: the hull of each component's points (rounded half to even), its area, perimeter and simplification.

    Components of fewer points than `least` (or 3), and hulls below max(12, spacing^2 * area_share), are dropped.
    An image's components come in one frame, and points meet their component by merges, as in _near().
    """
    own = members.hint("merge").join(points, ["image_id", "pid"]).hint("merge").join(spacings, "image_id").select("image_id", "comp_id", "x", "y", "spacing")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image, s, rows = pdf["image_id"].iloc[0], float(pdf["spacing"].iloc[0]), []
        ids, sizes = np.unique(pdf["comp_id"].to_numpy(), return_counts=True)
        at = np.rint(pdf[["x", "y"]].to_numpy()).astype(np.int64)[np.argsort(pdf["comp_id"].to_numpy(), kind="stable")]
        shape = lambda p: [{"x": int(x), "y": int(y)} for x, y in p]
        for comp, n, end in zip(ids.tolist(), sizes.tolist(), np.cumsum(sizes).tolist(), strict=True):
            if n < max(3, least):
                continue
            corner = kernels.convex_hull(at[end - n : end])
            area, size = kernels.polygon_area(corner), kernels.polygon_perimeter(corner)
            if len(corner) < 3 or area < max(12.0, s * s * area_share):
                continue
            small = kernels.simplify(corner, max(max(eps_min, s * eps), size * poly_eps))
            rows.append({"image_id": image, "comp_id": comp, "n_points": n, "area": area, "perimeter": size, "hull": shape(corner), "simplified": shape(small)})
        return pd.DataFrame(rows, columns=[c.split()[0] for c in HULL.split(", ")])

    return own.groupBy("image_id").applyInPandas(run, HULL)


def polygon_area(polygons: DataFrame, column: str = "hull") -> DataFrame:
    """Shoelace over an array of corners, without leaving the JVM."""
    n, p = F.size(column), F.col(column)
    nxt = lambda i: p[(i + 1) % n]
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: p[i]["x"] * nxt(i)["y"] - p[i]["y"] * nxt(i)["x"])
    return polygons.withColumn("shoelace", F.abs(F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)) / 2.0)


def polygon_perimeter(polygons: DataFrame, column: str = "hull") -> DataFrame:
    n, p = F.size(column), F.col(column)
    side = lambda i: F.sqrt((p[i]["x"] - p[(i + 1) % n]["x"]) ** 2 + (p[i]["y"] - p[(i + 1) % n]["y"]) ** 2)
    return polygons.withColumn("around", F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), side), F.lit(0.0), lambda a, x: a + x))


def _drawn(shapes, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of polygons, filled and outlined."""
    full, line = np.zeros((height, width), bool), np.zeros((height, width), bool)
    for corners in shapes:
        p = np.array([(c["x"], c["y"]) for c in corners], np.int64)
        full |= kernels.fill_polygon((height, width), p)
        line |= kernels.draw_polygon((height, width), p)
    return full, line


def rasterise(regions: DataFrame, width: int, height: int) -> DataFrame:
    """For each image the union of its regions: filled (instances), outlined (boundary) and as signatures of 180.

    One binary cell a mask, a byte for each pixel.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        full, line = _drawn(pdf["simplified"], width, height)
        as_bytes = lambda m, v: (m.astype(np.uint8) * v).tobytes()
        return pd.DataFrame([{"image_id": pdf["image_id"].iloc[0], "instances": as_bytes(full, 255), "boundary": as_bytes(line, 255), "signature": as_bytes(full, 180)}])

    return regions.select("image_id", "simplified").groupBy("image_id").applyInPandas(run, "image_id long, instances binary, boundary binary, signature binary")


def region_masks(images: DataFrame, points: DataFrame, width: int, height: int, kind: str = "line", params=None) -> DataFrame:
    """The mask of each image (image_id): outlines for `line`, filled regions for `instances` (also called `band`).

    An image with fewer than four centres has an empty mask, and its count of centres to tell.
    """
    from stipple.plans.params import Boundary

    if kind not in ("line", "band", "instances"):
        raise ValueError("kind must be line, band or instances")
    p = params or Boundary()
    counts = points.groupBy("image_id").agg(F.count(F.lit(1)).alias("centres"))
    enough = points.join(counts.filter("centres >= 4").select("image_id"), "image_id", "left_semi")
    s = spacing(nearest_neighbours(enough))
    members = point_components(annulus_edges(enough, s, p.min_r, p.max_r))
    regions = hulls(members, enough, s, p.min_points, p.hull_area, p.eps, p.eps_min, p.poly_eps).groupBy("image_id").agg(F.collect_list(F.struct("simplified")).alias("shapes"))
    rows = images.select("image_id").distinct().join(counts, "image_id", "left").join(regions, "image_id", "left").select("image_id", F.coalesce("centres", F.lit(0)).cast("long").alias("centres"), "shapes")

    def run(frames):
        for pdf in frames:
            for image, centres, shapes in pdf.itertuples(index=False):
                full, outline = _drawn([] if shapes is None else [r["simplified"] for r in shapes], width, height)
                yield pd.DataFrame({"image_id": [image], "centres": [centres], "mask": [((outline if kind == "line" else full).astype(np.uint8) * 255).tobytes()]})

    # corners move, masks don't; by number, as few bytes of corners make many masks, which must not meet in one task
    spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")
    return spread.mapInPandas(run, f"image_id {rows.schema['image_id'].dataType.simpleString()}, centres long, mask binary")
