"""The three programs from files to files, and what they need of the operators."""

import json

import numpy as np
import pytest
from test_images import P, dots, strips

from stipple.functions import kernels
from stipple.operators import lines, pixels
from stipple.plans import params, program
from stipple.sources import images


def test_photos_to_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "seat.png").write_bytes(images.png(dots()))
    assert program.photos(spark, str(tmp_path / "in"), str(tmp_path / "out"), P) == 4
    names = {x.name for x in (tmp_path / "out").iterdir() if x.is_file()}
    assert names == {"seat_holes_bw.png", "seat_threshold_raw.png", "seat_holes_bw_inverted.png", "seat_holes_preview.png"}
    mask = images.read_masks(spark, str(tmp_path / "out")).first()
    assert (mask["height"], mask["width"]) == (128, 128) and kernels.label(np.frombuffer(mask["data"], np.uint8).reshape(128, 128) > 0).max() == 63
    assert sorted(r["n_points"] for r in spark.read.json(str(tmp_path / "out" / "regions")).collect()) == [27, 36]


def test_patterns_to_documents_and_comparisons(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, a in (("a", strips()), ("b", np.roll(strips(), 6, axis=1))):
        (tmp_path / "in" / f"{name}_matrix_instances_bw.png").write_bytes(images.png(a))
    p = params.Params(geometry=params.Geometry(inset=28, votes=60, min_length=120))
    assert program.patterns(spark, str(tmp_path / "in"), str(tmp_path / "geo"), p) == 2
    docs = {k: json.loads((tmp_path / "geo" / f"geo_{k}.json").read_text()) for k in "ab"}
    assert list(docs["a"]) == ["source", "width", "height", "inner_rect", "line_count", "node_count", "segment_count", "lines", "nodes", "segments"]
    for doc in docs.values():
        assert doc["line_count"] == len(doc["lines"]) == 6 and doc["segment_count"] == len(doc["segments"]) > 8
        assert [s["id"] for s in doc["segments"]] == [f"S{k}" for k in range(len(doc["segments"]))]
    assert program.comparisons(spark, str(tmp_path / "geo"), str(tmp_path / "vs")) == 1
    found = json.loads((tmp_path / "vs" / "geo_a_vs_geo_b.json").read_text())
    assert (found["reference_file"], found["target_file"]) == ("geo_a.json", "geo_b.json") and found["matched_node_count"] > 8
    assert program.comparisons(spark, str(tmp_path / "geo"), str(tmp_path / "none"), ref=7) == 0


def test_black_between_nodes_decides(spark):
    own = spark.createDataFrame([(1, 0, 0, 50.0, 50.0, 1.0, 0.0, -60.0, 60.0), (1, 1, 1, 50.0, 50.0, 0.0, 1.0, -60.0, 60.0)], "image_id long, line_id long, family long, ox double, oy double, dx double, dy double, tmin double, tmax double")
    rects = spark.createDataFrame([(1, 0, 0, 100, 100)], "image_id long, left long, top long, right long, bottom long")
    dark = {(x, 50) for x in range(50, 101)} | {(50, y) for y in range(0, 40)} | {(50, 50)}  # right of the crossing; most of what is above it
    black = spark.createDataFrame([(1, x, y, 101, 101) for x, y in dark], "image_id long, x long, y long, w long, h long")
    crossed = lines.crossings(own, rects, black)
    hits = lines.rect_hits(own, rects)
    nodes = lines.line_nodes(own, crossed, hits, black=black)
    assert sorted((r["node_id"], r["x"], r["y"]) for r in nodes.filter("kind = 'boundary'").collect()) == [("B1", 100.0, 50.0), ("B2", 50.0, 0.0)]
    assert lines.line_nodes(own, crossed, hits).filter("kind = 'boundary'").count() == 4
    segs = lines.line_segments(lines.line_nodes(own, crossed, hits), 20, black).orderBy("seg_id").collect()
    assert [r["seg_id"] for r in segs] == ["S0", "S1"] and all(r["black_ratio"] >= 0.45 for r in segs)


def test_white_first_segment_hides_no_black_later_one(spark):
    rows = [(1, line, n, "crossing", int(n[1]), x, y, t) for line, y in ((0, 10.0), (1, 30.0)) for n, x, t in (("C0", 0.0, 0.0), ("C1", 90.0, 90.0))]
    nodes = spark.createDataFrame([(a, b, c, d, e, f, g, h) for a, b, c, d, e, f, g, h in [(r[0], r[1], r[2], r[3], r[4], r[5], 10.0 if r[1] == 0 else 30.0, r[7]) for r in rows]], "image_id long, line_id long, node_id string, kind string, n long, x double, y double, t double")
    black = spark.createDataFrame([(1, x, 30, 100, 100) for x in range(100)], "image_id long, x long, y long, w long, h long")
    got = lines.line_segments(nodes, 80, black).collect()
    assert [(r["seg_id"], r["line_index"], r["black_ratio"]) for r in got] == [("S0", 1, 1.0)]


@pytest.mark.parametrize("shape", ["ellipse", "rect", "cross"])
@pytest.mark.parametrize("px", [1, 5, 40, 63])
def test_bands_of_any_width(spark, px, shape):
    a = np.zeros((70, 80), bool)
    a[30, 20:50] = a[10:60, 35] = True
    line = spark.createDataFrame([(1, int(x), int(y)) for y, x in np.argwhere(a)], "image_id long, x long, y long")
    spacing = spark.createDataFrame([(1, 20.0)], "image_id long, spacing double")
    got = pixels.band_mask(line, spacing, 80, 70, px=px, shape=shape, frame=2, style="white_on_black")
    want = kernels.dilate(a, kernels.element(px + (px % 2 == 0), shape))
    want[:2] = want[-2:] = want[:, :2] = want[:, -2:] = True
    assert {(r["x"], r["y"]) for r in got.collect()} == {(int(x), int(y)) for y, x in np.argwhere(want)} and got.first()["v"] == 255
