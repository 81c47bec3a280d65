"""NumPy kernels against brute force and by their properties."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stipple.functions import kernels as k

RNG = np.random.default_rng(9)
MASKS = st.tuples(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32)).map(lambda t: np.random.default_rng(t[2]).random((t[0], t[1])) < 0.4)


def brute(a, kernel, f, start):
    h, w = a.shape
    out = np.zeros_like(a)
    for y, x in itertools.product(range(h), range(w)):
        seen = [a[y + dy, x + dx] for dx, dy in k.offsets(kernel) if 0 <= y + dy < h and 0 <= x + dx < w]
        out[y, x] = f(seen) if seen else start
    return out


@given(MASKS, st.integers(1, 6), st.sampled_from(["ellipse", "rect", "cross"]))
@settings(max_examples=60, deadline=None)
def test_morphology(mask, size, shape):
    kernel = k.element(size, shape)
    assert (k.dilate(mask, kernel) == brute(mask, kernel, max, False)).all()
    assert (k.erode(mask, kernel) == brute(mask, kernel, min, True)).all()
    if size % 2:
        assert (k.dilate(mask, kernel) >= mask).all() and (k.open_(mask, kernel) <= mask).all()
        once = k.close_(mask, kernel)
        assert (k.close_(once, kernel) == once).all()


@given(MASKS)
@settings(max_examples=60, deadline=None)
def test_labels_are_components(mask):
    labels = k.label(mask)
    assert ((labels > 0) == mask).all()
    cells = [tuple(c) for c in np.argwhere(mask)]
    near = {(a, b) for a in cells for b in cells if max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1}
    assert all(labels[a] == labels[b] for a, b in near)
    group = {c: {c} for c in cells}
    for a, b in near:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for c in group[a]:
                group[c] = group[a]
    assert len({id(g) for g in group.values()}) == labels.max(initial=0)
    assert sum(s["area"] for s in k.stats(labels)) == mask.sum()


def test_ellipse_shapes():
    assert k.ellipse(1).tolist() == [[True]]
    assert k.ellipse(3).sum() == 5 and k.ellipse(5).sum() == 17 and k.ellipse(5)[0].tolist() == [False, False, True, False, False]
    with pytest.raises(ValueError):
        k.element(3, "star")


def test_chamfer_is_near_the_distance():
    mask = np.ones((60, 70), bool)
    mask[10, 12] = mask[50, 60] = mask[30, 5] = False
    ys, xs = np.mgrid[:60, :70]
    exact = np.min([np.hypot(ys - y, xs - x) for y, x in np.argwhere(~mask)], axis=0)
    assert np.abs(k.chamfer(mask) - exact).max() <= 0.03 * exact.max()


def test_thinning():
    band = np.zeros((40, 60), bool)
    band[15:24, 5:55] = True
    line = k.thin(band)
    assert (line <= band).all() and line.sum(0).max() <= 2 and k.label(line).max() == 1 and line.sum() > 40
    assert (k.thin(line) == line).all()


def test_adaptive_threshold_finds_dark_dots():
    image = np.full((60, 60), 200, np.uint8)
    image[20:24, 20:24] = 60
    hit = k.adaptive_threshold(image, 15, 7)
    assert hit[20:24, 20:24].all() and hit.sum() == 16
    with pytest.raises(ValueError):
        k.adaptive_threshold(image, 4)


def test_crop():
    image = np.arange(100, dtype=np.uint8).reshape(10, 10)
    out, corner = k.crop_polygon(image, [(2, 1), (7, 1), (7, 6), (2, 6)])
    assert corner == (2, 1) and (out == image[1:7, 2:8]).all()
    cut, _ = k.crop_polygon(image, [(2, 1), (7, 1), (2, 6), (2, 4)])
    assert cut[5, 5] == 255 and cut[0, 0] == image[1, 2]
    with pytest.raises(ValueError):
        k.crop_polygon(image, [(2, 1), (2, 5), (2, 6), (2, 2)])


def test_resizing():
    a = RNG.integers(0, 256, (8, 12)).astype(np.uint8)
    assert (k.area_resize(a, 2, 3) == np.floor(a.reshape(2, 4, 3, 4).mean((1, 3)) + 0.5)).all()
    assert k.area_resize(np.full((7, 5), 9, np.uint8), 3, 2).tolist() == [[9, 9]] * 3
    assert (k.nearest_resize(k.nearest_resize(a, 16, 24), 8, 12) == a).all()


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=3, max_size=40))
@settings(max_examples=80, deadline=None)
def test_hull_holds_all_points(points):
    p = np.array(points)
    hull = k.convex_hull(p)
    if len(hull) > 2 and k.polygon_area(hull) > 0:
        assert k.inside_polygon(hull, p[:, 0], p[:, 1]).all()
        kept = k.simplify(hull, 1.5)
        assert 3 <= len(kept) <= len(hull) and (k.simplify(hull, 0.0) == hull).all()


def test_fill_and_outline():
    square = np.array([(2, 2), (7, 2), (7, 6), (2, 6)])
    assert k.fill_polygon((10, 10), square).sum() == 30 and k.draw_polygon((10, 10), square).sum() == 18
    assert k.polygon_area(square) == 20 and k.polygon_perimeter(square) == 18


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (2, 5), (5, 2), (6, 6), (0, 3)])
def test_assignment_is_cheapest(shape):
    for _ in range(30):
        c = RNG.integers(0, 20, shape).astype(float)
        pairs = k.assignment(c)
        n, m = shape
        assert len(pairs) == min(n, m) and len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
        best = min((sum(c[a, b] for a, b in zip(rows, cols, strict=True)) for rows in [range(n)] for cols in itertools.permutations(range(m), n)), default=0) if n <= m else min(sum(c[a, b] for b, a in enumerate(rows)) for rows in itertools.permutations(range(n), m))
        assert sum(c[a, b] for a, b in pairs) == best
    assert k.assignment([[1, 2], [1, 10]]) == [(0, 1), (1, 0)]


def test_hough_finds_lines():
    mask = np.zeros((400, 500), bool)
    k.draw_line(mask, (20, 30), (480, 300))
    k.draw_line(mask, (50, 380), (300, 20))
    found = k.hough_segments(mask, 80, 160, 80)
    turn = lambda s: math.degrees(math.atan2(s[3] - s[1], s[2] - s[0])) % 180
    assert sorted(round(turn(s) / 3) for s in found[:2]) == sorted(round(t / 3) for t in (math.degrees(math.atan2(270, 460)), math.degrees(math.atan2(-360, 250)) % 180))
    assert k.hough_segments(np.zeros((5, 5), bool)) == []


def test_centreline_of_crossing_bands():
    image = np.full((400, 400), 255, np.uint8)
    ys, xs = np.mgrid[:400, :400]
    image[np.abs(xs - ys) < 25] = 0
    image[np.abs(xs + ys - 400) < 25] = 0
    line = k.centreline(image)
    far = np.minimum(np.abs(xs - ys), np.abs(xs + ys - 400))[line]
    assert line.sum() > 500 and np.percentile(far, 95) <= 16
    with pytest.raises(ValueError):
        k.centreline(image, scale=2)
    with pytest.raises(ValueError):
        k.centreline(image, angles=3)
