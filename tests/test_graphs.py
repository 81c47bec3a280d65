"""Line graphs and their comparison, against published documents (FIXTURES.md) and hand-made cases."""

import os
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stipple.functions import kernels
from stipple.operators import compare, draw, lines, points, series
from stipple.sources import geo

TEXT = open(os.path.join(os.path.dirname(__file__), "..", "FIXTURES.md"), encoding="utf-8").read()


def golden(name):
    part = TEXT[TEXT.index(f"#### {name} ") :]
    part = part[: part.index("```", part.index("```csv") + 6)]
    head = re.search(r"width=(\d+) height=(\d+) inner_rect=\[([\d, ]+)\]", part)
    rows = {"lines": [], "nodes": [], "segments": []}
    for line in part.splitlines():
        if re.fullmatch(r"\d+,[01],[-\d.,]+", line):
            v = line.split(",")
            rows["lines"].append((int(v[0]), int(v[1]), *map(float, v[2:6]), int(v[6]), float(v[7])))
        elif re.match(r"C0:\d", line):
            rows["nodes"] = [x.split(":") for x in line.split()]
        elif re.match(r"S0:\d", line):
            rows["segments"] = [x.split(":") for x in line.split()]
    return int(head[1]), int(head[2]), [int(x) for x in head[3].split(",")], rows


GOLD = {k: golden(f"G{k}") for k in (1, 2, 3)}


def moves(name):
    part = TEXT[TEXT.index(f"#### {name} ") :]
    part = part[: part.index("```", part.index("```csv") + 6)]
    mapping = dict(x.split(">") for x in re.search(r"node_mapping: (.*)", part)[1].split())
    rows = {(v[0], v[1]): tuple(map(float, v[2:])) for v in (x.split(",") for x in part.splitlines() if re.match(r"S\d+,S\d+,", x))}
    return mapping, rows


@pytest.fixture(scope="module")
def gold_nodes(spark):
    rows = [(k, n[0], "crossing" if n[0][0] == "C" else "boundary", float(n[1]), float(n[2])) for k, g in GOLD.items() for n in g[3]["nodes"]]
    return spark.createDataFrame(rows, "image_id long, node_id string, kind string, x double, y double")


@pytest.fixture(scope="module")
def gold_segments(spark):
    rows = []
    for k, g in GOLD.items():
        at = {n[0]: (int(n[1]), int(n[2])) for n in g[3]["nodes"]}
        rows += [(k, s[0], int(s[1]), s[2], s[3], *at[s[2]], *at[s[3]]) for s in g[3]["segments"]]
    return spark.createDataFrame(rows, "image_id long, seg_id string, line_index long, from_node string, to_node string, x0 long, y0 long, x1 long, y1 long")


def test_published_graphs_are_rebuilt(spark):
    rows = [(k, *ln[:6], -1e6, 1e6) for k, g in GOLD.items() for ln in g[3]["lines"]]
    own = spark.createDataFrame(rows, "image_id long, line_id long, family long, ox double, oy double, dx double, dy double, tmin double, tmax double")
    rects = spark.createDataFrame([(k, *g[2]) for k, g in GOLD.items()], "image_id long, left long, top long, right long, bottom long")
    crossed = lines.crossings(own, rects)
    nodes = lines.line_nodes(own, crossed, lines.rect_hits(own, rects))
    got = {(r.image_id, r.node_id): (r.x, r.y) for r in nodes.toPandas().itertuples()}
    for k, g in GOLD.items():
        want = {n[0]: (int(n[1]), int(n[2])) for n in g[3]["nodes"]}
        assert {n for i, n in got if i == k} == set(want)
        assert all(np.abs(np.subtract(got[k, n], p)).max() < 1 for n, p in want.items())
    segs = lines.line_segments(nodes).toPandas()
    for k, g in GOLD.items():
        mine = segs[segs.image_id == k]
        assert [(r.seg_id, r.line_index, r.from_node, r.to_node) for r in mine.sort_values("seg_id", key=lambda s: s.str[1:].astype(int)).itertuples()] == [(s[0], int(s[1]), s[2], s[3]) for s in g[3]["segments"]]
        assert np.allclose(mine.set_index("seg_id").loc[[s[0] for s in g[3]["segments"]]].length, [float(s[4]) for s in g[3]["segments"]], atol=0.011)


def test_published_comparisons(gold_nodes, gold_segments):
    matches = compare.match_nodes(gold_nodes, gold_segments, 1)
    moved = compare.transforms(compare.match_segments(gold_segments, matches, 1)).toPandas()
    pairs = matches.toPandas()
    for k in (2, 3):
        mapping, want = moves(f"M{k}")
        own = pairs[pairs.image_id == k]
        assert dict(zip(own.ref_node, own.tgt_node, strict=True)) == mapping
        got = {(r.ref_segment, r.target_segment): (r.rotation_deg, *r.translation_midpoint_xy, *r.rigid_translation_xy, r.length_ratio) for r in moved[moved.image_id == k].itertuples()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[x], want[x], atol=2e-6) for x in want)
    docs = {r["image_id"]: r for r in compare.comparison_documents(gold_nodes, gold_segments, 1).collect()}
    assert all((docs[k]["matched_node_count"], docs[k]["matched_segment_count"], docs[k]["target_node_count"]) == (18, 18, 18) for k in (2, 3))
    names = [m["ref_segment"] for m in docs[2]["segment_matches"]]
    assert names == sorted(names) and docs[3]["node_mapping"]["C2"] == "C3"
    shapes = draw.comparison_shapes(compare.transforms(compare.match_segments(gold_segments, matches, 1)).filter("image_id = 2"), gold_segments, 1631, 1)
    assert shapes.count() == 54


def test_swapped_and_repeated_segments(spark):
    nodes = spark.createDataFrame([(i, n, "crossing", x + 5.0 * i, y) for i in (0, 1) for n, x, y in (("C0", 0.0, 0.0), ("C1", 100.0, 0.0), ("C2", 0.0, 300.0))], "image_id long, node_id string, kind string, x double, y double")
    rows = [(0, "S0", "C0", "C1", 0, 0, 100, 0), (0, "S1", "C0", "C2", 0, 0, 0, 300), (1, "S0", "C1", "C0", 105, 0, 5, 0), (1, "S9", "C0", "C1", 5, 0, 105, 50), (1, "S10", "C1", "C0", 105, 0, 5, 0), (0, "S7", "C1", "C1", 1, 1, 1, 1), (1, "S8", "C1", "C1", 1, 1, 4, 5)]
    segs = spark.createDataFrame(rows, "image_id long, seg_id string, from_node string, to_node string, x0 long, y0 long, x1 long, y1 long")
    out = {r["ref_segment"]: r for r in compare.transforms(compare.match_segments(segs, compare.match_nodes(nodes, segs, 0), 0)).collect()}
    assert out["S0"]["target_segment"] == "S10" and abs(out["S0"]["rotation_deg"]) == 180.0 and "S1" not in out
    assert out["S7"]["length_ratio"] == pytest.approx(5e9)


def test_families_and_clusters():
    angles = np.array([0.5, 0.52, 2.1, 2.12, 0.49, 2.08])
    labels, directions = lines.families(angles)
    assert labels.tolist() == [0, 0, 1, 1, 0, 1] and np.allclose(np.hypot(*directions.T), 1)
    assert lines.rho_clusters(np.array([0.0, 50, 100, 400, 10]), np.ones(5)).tolist() == [0, 0, 1, 2, 0]
    assert lines.families(np.array([1.0]))[0].tolist() == [0]


def test_too_few_segments_give_no_lines(spark):
    rows = [(1, 0, 0, 0, 200, 0), (2, 0, 0, 0, 200, 0), (2, 1, 0, 0, 0, 300), (2, 2, 0, 0, 5, 5)]
    out = lines.segment_features(spark.createDataFrame(rows, "image_id long, seg_no long, x1 long, y1 long, x2 long, y2 long"))
    assert sorted((r["image_id"], r["seg_no"]) for r in out.collect()) == [(2, 0), (2, 1)]


def test_parallel_lines_and_lines_without_crossings(spark):
    own = spark.createDataFrame([(1, 0, 0, 100.0, 100.0, 1.0, 0.0, -50.0, 50.0), (1, 1, 1, 100.0, 300.0, 1.0, 0.0, -50.0, 50.0), (1, 2, 0, 100.0, 200.0, 1.0, 0.0, 5000.0, 6000.0)], "image_id long, line_id long, family long, ox double, oy double, dx double, dy double, tmin double, tmax double")
    rects = spark.createDataFrame([(1, 0, 0, 200, 400)], "image_id long, left long, top long, right long, bottom long")
    crossed = lines.crossings(own, rects)
    assert crossed.count() == 0
    nodes = lines.line_nodes(own, crossed, lines.rect_hits(own, rects)).orderBy("n").collect()
    assert [(r["line_id"], r["node_id"], r["x"]) for r in nodes] == [(0, "B0", 0.0), (0, "B1", 200.0), (1, "B2", 0.0), (1, "B3", 200.0)]


def test_neighbours_with_copies_and_far_points(spark):
    rng = np.random.default_rng(2)
    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((200, 2)) * 50)] + [(1, 900, 1e5, 1e5), (2, 0, 1.0, 1.0), (2, 1, 1.0, 1.0), (3, 0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "image_id long, pid long, x double, y double")
    got = {(r["image_id"], r["pid"]): r["d"] for r in points.nearest_neighbours(df).collect()}
    for i, p, x, y in rows:
        d = [np.hypot(x - u, y - v) for j, q, u, v in rows if j == i and q != p]
        assert got.get((i, p)) == (pytest.approx(min(d)) if d else None)
    s = {r["image_id"]: r["spacing"] for r in points.spacing(points.nearest_neighbours(df)).collect()}
    assert s[2] == 0.0 and 3 not in s


@pytest.fixture(scope="module")
def grid(spark, tmp_path_factory):
    """Six images of 5 x 5 holes, ten apart, each with one hole far off, from files whose size tells little of their rows."""
    rows = [(i, i * 100 + k, 10.0 * (k % 5), 10.0 * (k // 5)) for i in range(6) for k in range(25)] + [(i, i * 100 + 99, 900.0, 40.0) for i in range(6)]
    folder = str(tmp_path_factory.mktemp("grid"))
    spark.createDataFrame(rows, "image_id long, pid long, x double, y double").write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def planned(df):
    """The plan, with those of the tables that it keeps."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_broadcast_no_points(grid):
    out = points.nearest_neighbours(grid)
    assert "BroadcastExchange" not in planned(out)
    assert sorted(r["d"] for r in out.collect()) == [10.0] * 150 + [860.0] * 6


def test_edges_broadcast_no_points(grid):
    edges = points.annulus_edges(grid, points.spacing(points.nearest_neighbours(grid)))
    assert "BroadcastExchange" not in planned(edges) and edges.count() == 6 * 72


def test_copies_of_points_have_edges_at_spacing_zero(spark):
    rows = [(1, i, 5.0, 5.0 + 9 * (i == 3)) for i in range(4)]
    df = spark.createDataFrame(rows, "image_id long, pid long, x double, y double")
    spacings = points.spacing(points.nearest_neighbours(df))
    assert sorted((r["u"], r["v"], r["d"]) for r in points.annulus_edges(df, spacings).collect()) == [(0, 1, 0.0), (0, 2, 0.0), (1, 2, 0.0)]


def test_components_broadcast_no_points(grid):
    out = points.point_components(points.annulus_edges(grid, points.spacing(points.nearest_neighbours(grid))))
    assert "BroadcastExchange" not in planned(out) and {(r["image_id"], r["comp_id"]) for r in out.collect()} == {(i, i * 100) for i in range(6)}


def test_component_sizes_broadcast_no_points(grid):
    out = points.component_sizes(points.point_components(points.annulus_edges(grid, points.spacing(points.nearest_neighbours(grid)))))
    assert "BroadcastExchange" not in planned(out)
    assert sorted(tuple(r) for r in out.select("image_id", "comp_id", "n_points").collect()) == [(i, i * 100, 25) for i in range(6)]


def test_spacings_broadcast_no_points(grid):
    out = points.spacing(points.nearest_neighbours(grid))
    assert "BroadcastExchange" not in planned(out) and {r["spacing"] for r in out.collect()} == {10.0}


def test_hulls_broadcast_no_points(grid):
    spacings = points.spacing(points.nearest_neighbours(grid))
    out = points.polygon_perimeter(points.polygon_area(points.hulls(points.point_components(points.annulus_edges(grid, spacings)), grid, spacings)))
    assert "BroadcastExchange" not in planned(out)
    got = [(r["comp_id"], r["n_points"], r["shoelace"], r["around"], len(r["simplified"])) for r in out.orderBy("image_id").collect()]
    assert got == [(i * 100, 25, 1600.0, 160.0, 4) for i in range(6)]


def test_masks_broadcast_no_points_and_are_drawn_by_many_tasks(spark, grid):
    out = points.region_masks(grid, grid, 60, 60, "band").persist()
    assert "InMemoryTableScan" in planned(out) and out.count() == 6
    assert len({r["task"] for r in out.select(F.spark_partition_id().alias("task")).collect()}) > 1
    for r in out.collect():
        mask = np.frombuffer(r["mask"], np.uint8).reshape(60, 60)
        assert r["centres"] == 26 and mask[:41, :41].min() == 255 and (mask > 0).sum() == 41 * 41
    out.unpersist()


def test_regions_with_different_numbers_of_corners_are_one_mask(spark):
    at = [(10.0 * (k % 3), 10.0 * (k // 3)) for k in range(9)] + [(100.0 + 10 * i, 10.0 * j) for j in range(3) for i in range(3 - j)]
    pts = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate(at)], "image_id long, pid long, x double, y double")
    mask = np.frombuffer(points.region_masks(pts, pts, 130, 30, "band").first()["mask"], np.uint8).reshape(30, 130)
    assert mask[:21, :21].min() == 255 and (mask > 0).sum() == 21 * 21 + 21 * 22 // 2


def test_empty_images_stay(spark):
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    rows = [(1, i, 10.0 + 10 * (i % 3), 10.0 + 10 * (i // 3)) for i in range(9)] + [(2, 0, 5.0, 5.0), (2, 1, 8.0, 8.0)]
    pts = spark.createDataFrame(rows, "image_id long, pid long, x double, y double")
    out = {r["image_id"]: (r["centres"], np.frombuffer(r["mask"], np.uint8).reshape(50, 50)) for r in points.region_masks(images, pts, 50, 50, "band").collect()}
    assert out[1][1][10:31, 10:31].min() == 255 and (out[1][1] > 0).sum() == 21 * 21
    assert out[2][0] == 2 and out[3][0] == 0 and not out[2][1].any() and not out[3][1].any()
    line = points.region_masks(images, pts, 50, 50, "line").filter("image_id = 1").first()["mask"]
    assert (np.frombuffer(line, np.uint8) > 0).sum() == 80
    with pytest.raises(ValueError):
        points.region_masks(images, pts, 50, 50, "other")


def test_series_operators(spark):
    rows = [("a", i, float(v), bool(b)) for i, (v, b) in enumerate(zip([1, 5, 2, 8, 3, 9, 4], [1, 1, 0, 1, 1, 0, 0], strict=True))] + [("b", 0, 1.0, False)]
    df = spark.createDataFrame(rows, "series_id string, pos long, value double, active boolean")
    for window in (1, 2, 3, 5):
        got = [r["smooth"] for r in series.box_smooth(df.filter("series_id = 'a'"), window).orderBy("pos").collect()]
        assert np.allclose(got, np.convolve([1, 5, 2, 8, 3, 9, 4], np.ones(window) / window, "same"))
    assert {tuple(r) for r in series.longest_span(df).collect()} == {("a", 0, 1), ("b", 0, -1)}


def test_documents_in_and_out(spark, tmp_path):
    import json

    for k, body in enumerate([{"width": 10, "height": 20, "nodes": [{"id": "C0", "kind": "crossing", "point": [1, 2]}], "segments": [{"id": "S0", "line_index": 0, "from": "C0", "to": "C0", "length": 1.0, "points": [[1, 2], [3, 4]]}], "inner_rect": [1, 2, 3, 4], "source": "x"}, {"width": 5, "height": 6}]):
        (tmp_path / f"geo_{k}.json").write_text(json.dumps(body, indent=2))
    docs = geo.read_geo(spark, str(tmp_path))
    rows = docs.orderBy("image_id").collect()
    assert rows[1]["inner_rect"] == [0, 0, 0, 0] and rows[1]["nodes"] == [] and rows[1]["source"].endswith("geo_1.json")
    assert geo.geo_segments(docs).first()["x1"] == 3 and geo.geo_nodes(docs).first()["y"] == 2.0 and geo.geo_rects(docs).count() == 2 and geo.geo_lines(docs).count() == 0
    assert json.loads(geo.to_json(docs).filter("image_id = 0").first()["text"])["width"] == 10
    geo.write_documents(docs.drop("path"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "geo.json").write_text('{"height": 3}')
    with pytest.raises(Exception, match="no width"):
        geo.read_geo(spark, str(bad)).collect()


def test_hull_queries_agree_with_kernels():
    p = pd.DataFrame({"x": [0, 4, 4, 0, 2], "y": [0, 0, 3, 3, 1]})
    hull = kernels.convex_hull(p.to_numpy())
    assert len(hull) == 4 and kernels.polygon_area(hull) == 12
