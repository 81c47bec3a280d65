"""Images in and out, the dense operators, and both image pipelines end to end on drawn pictures."""

import numpy as np
import pytest

from stipple.functions import kernels
from stipple.operators import dense, pixels
from stipple.plans import params, pipeline
from stipple.sources import images
from stipple.streaming import images as stream

DDL = "image_id long, height int, width int, data binary"


def rows(*pictures):
    return [(k, a.shape[0], a.shape[1], np.ascontiguousarray(a, np.uint8).tobytes()) for k, a in enumerate(pictures)]


def dots():
    a = np.full((128, 128), 230, np.uint8)
    ys, xs = np.mgrid[:128, :128]
    for y in range(16, 116, 12):
        for x in range(16, 116, 12):
            if not 50 < x < 75:
                a[(ys - y) ** 2 + (xs - x) ** 2 <= 9] = 20
    a[57:59, 46:71] = 20
    a[120, 120] = 20
    return a


P = params.Params(roi=params.Roi(128, 128, (0, 0, 127, 0, 127, 127, 0, 127)), holes=params.Holes(clean=3, merge=3))


def test_png_and_image_source(spark, tmp_path):
    rgb = np.zeros((4, 5, 3), np.uint8)
    rgb[..., 0], rgb[1, 2] = 10, (1, 2, 3)
    (tmp_path / "b.PNG").write_bytes(images.png(rgb))
    (tmp_path / "a_holes_bw.png").write_bytes(images.png(np.array([[0, 127, 128, 255]], np.uint8)))
    (tmp_path / "a_crop.jpg").write_bytes(images.png(rgb))
    (tmp_path / "note.txt").write_text("no image")
    got = {r["origin"].rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert set(got) == {"b.PNG", "a_holes_bw.png", "a_crop.jpg"}
    assert (np.frombuffer(got["b.PNG"]["data"], np.uint8).reshape(4, 5, 3) == rgb).all()
    masks = images.read_masks(spark, str(tmp_path))
    assert list(masks.first()["data"]) == [0, 0, 255, 255]
    assert images.join_masks_with_rois(masks, images.read_images(spark, str(tmp_path))).first()["roi_name"] == "a_crop.jpg"
    (tmp_path / "broken.png").write_bytes(b"no")
    with pytest.raises(Exception, match="not an image"):
        images.read_images(spark, str(tmp_path)).collect()
    assert images.artifact_name("comparison", ref="a", tgt="b") == "a_vs_b.json"
    out = images.encode_png(spark.createDataFrame([("x", 4, 5, rgb.tobytes())], "name string, height int, width int, data binary")).first()
    assert out["content"] == images.png(rgb)


def test_photo_to_regions(spark):
    photos = spark.createDataFrame(rows(dots(), np.full((128, 128), 230)), DDL)
    got = pipeline.photo_to_regions(photos, P)
    centres = got["centres"].filter("image_id = 0").toPandas()
    assert len(centres) == 63 and got["centres"].filter("image_id = 1").count() == 0
    assert np.abs(((centres[["x", "y"]] - 16) / 12 - ((centres[["x", "y"]] - 16) / 12).round())).to_numpy().max() < 0.1
    assert got["spacings"].first()["spacing"] == pytest.approx(12, abs=0.5)
    regions = sorted(r["n_points"] for r in got["regions"].collect())
    assert regions == [27, 36]
    hole = got["holes"].filter("image_id = 0").first()
    assert (np.frombuffer(hole["mask"], np.uint8) + np.frombuffer(hole["inverse"], np.uint8) == 255).all()


def test_crop_scales_and_clips(spark):
    p = params.Roi(100, 100, (10, 10, 90, 10, 90, 120, 10, 90))
    out = dense.crops(spark.createDataFrame(rows(np.zeros((50, 50))), DDL), p).first()
    assert (out["height"], out["width"]) == (45, 41)
    assert dense.rescaled(spark.createDataFrame(rows(np.zeros((50, 40))), DDL), 0.5).first()["height"] == 25


def test_relations_agree_with_kernels(spark):
    a = (np.random.default_rng(3).random((20, 24)) < 0.5).astype(np.uint8) * 255
    df = spark.createDataFrame(rows(a), DDL)
    px = pixels.set_pixels(dense.pixels(df))
    for name, f, g in (("dilate", pixels.dilate, kernels.dilate), ("erode", pixels.erode, kernels.erode), ("open", pixels.open_, kernels.open_), ("close", pixels.close_, kernels.close_)):
        for k in (3, 6):
            want = {(int(x), int(y)) for y, x in np.argwhere(g(a, kernels.ellipse(k)) > 0)}
            assert {(r["x"], r["y"]) for r in f(px, 24, 20, k).collect()} == want, (name, k)
            assert np.count_nonzero(np.frombuffer(dense.morphology(df, name, k).first()["data"], np.uint8)) == len(want)
    full = dense.pixels(df)
    got = {(r["x"], r["y"]): r["hole"] for r in pixels.gauss_threshold(full, kernels.gaussian(5).tolist(), 7).collect()}
    want = kernels.adaptive_threshold(a, 5, 7)
    assert all(got[x, y] == want[y, x] for y in range(20) for x in range(24))
    labels = {(r["x"], r["y"]): r["label"] for r in pixels.components(px).collect()}
    own = kernels.label(a > 0)
    assert len({(labels[x, y], own[y, x]) for x, y in labels}) == own.max()


def strips():
    image = np.full((700, 700), 255, np.uint8)
    ys, xs = np.mgrid[:700, :700]
    for c in (-250, 0, 250):
        image[np.abs((xs - ys) / 2**0.5 - c / 2**0.5) < 16] = 0
        image[np.abs((xs + ys - 700) / 2**0.5 - c / 2**0.5) < 16] = 0
    return image


def test_regions_to_graph(spark):
    p = params.Params(geometry=params.Geometry(inset=28, votes=60, min_length=120))
    got = pipeline.regions_to_graph(spark.createDataFrame(rows(strips()), DDL), p)
    found = got["lines"].toPandas()
    assert len(found) == 6 and sorted(found.family.value_counts()) == [3, 3]
    assert (np.abs(np.abs(found.dx) - np.abs(found.dy)) < 0.05).all()
    nodes = got["nodes"].filter("kind = 'crossing'").select("node_id", "x", "y").distinct().toPandas()
    true = [((700 + c + d) / 2, (700 + d - c) / 2) for c in (-250, 0, 250) for d in (-250, 0, 250)]
    true = [t for t in true if 28 <= t[0] <= 671 and 28 <= t[1] <= 671]
    assert len(nodes) == len(true) and all(min(np.hypot(x - a, y - b) for a, b in true) < 12 for x, y in zip(nodes.x, nodes.y, strict=True))
    doc = got["documents"].first()
    assert doc["line_count"] == 6 and doc["node_count"] == len(doc["nodes"]) and doc["segment_count"] == len(doc["segments"]) > 8
    assert all(s["black_ratio"] >= 0.45 for s in doc["segments"])


def test_stream_of_photos(spark, tmp_path):
    spark.createDataFrame(rows(dots()), DDL).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has nothing to do
        stream.run_once(stream.hole_stream(spark, str(tmp_path / "in"), P), str(tmp_path / "out"), str(tmp_path / "state"))
    assert [r["centre_count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [63]


@pytest.mark.parametrize("make", [lambda: params.Roi(points=(1, 2)), lambda: params.Holes(block=4), lambda: params.Holes(min_area=9, max_area=3), lambda: params.Boundary(min_r=2), lambda: params.Output(kind="x"), lambda: params.Centreline(scale=0), lambda: params.Centreline(angles=3), lambda: params.Params(image_scale=0)])
def test_wrong_parameters(make):
    with pytest.raises(ValueError):
        make()
