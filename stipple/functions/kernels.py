"""NumPy kernels on single images: dense arrays in, dense arrays out.  No Spark here."""

from __future__ import annotations

import math

import numpy as np


def ellipse(k: int, h: int | None = None) -> np.ndarray:
    """An elliptic k x k mask; an even one leans to the lower right of its anchor (k // 2, k // 2)."""
    h = h or k
    r, c = h // 2, k // 2
    out = np.zeros((h, k), bool)
    for i in range(h):
        dy = i - r
        if abs(dy) <= r:
            dx = int(np.rint(c * math.sqrt(max(0.0, 1 - dy * dy / (r * r) if r else 1.0))))
            out[i, max(c - dx, 0) : min(c + dx + 1, k)] = True
    return out


def element(k: int, shape: str = "ellipse") -> np.ndarray:
    if shape == "ellipse":
        return ellipse(k)
    if shape == "rect":
        return np.ones((k, k), bool)
    if shape == "cross":
        out = np.zeros((k, k), bool)
        out[k // 2, :] = out[:, k // 2] = True
        return out
    raise ValueError(f"unknown kernel shape {shape!r}")


def offsets(kernel: np.ndarray) -> list[tuple[int, int]]:
    """(dx, dy) of the kernel's cells from its anchor."""
    ky, kx = kernel.shape
    return [(int(x) - kx // 2, int(y) - ky // 2) for y, x in np.argwhere(kernel)]


def _shifted(a: np.ndarray, dx: int, dy: int, fill) -> np.ndarray:
    h, w = a.shape
    out = np.full_like(a, fill)
    if abs(dx) < w and abs(dy) < h:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def dilate(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The greatest value under the kernel; cells outside the image have no say."""
    out = None
    for dx, dy in offsets(kernel):
        s = _shifted(a, dx, dy, np.iinfo(a.dtype).min if a.dtype != bool else False)
        out = s if out is None else np.maximum(out, s)
    return out


def erode(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    out = None
    for dx, dy in offsets(kernel):
        s = _shifted(a, dx, dy, np.iinfo(a.dtype).max if a.dtype != bool else True)
        out = s if out is None else np.minimum(out, s)
    return out


def close_(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return erode(dilate(a, kernel), kernel)


def open_(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return dilate(erode(a, kernel), kernel)


def gray(bgr: np.ndarray) -> np.ndarray:
    c = bgr.astype(np.int64)
    return ((c[..., 0] * 114 + c[..., 1] * 587 + c[..., 2] * 299 + 500) // 1000).astype(np.uint8)


def nearest_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = a.shape[:2]
    ys = np.minimum((np.arange(height) * h) // height, h - 1)
    xs = np.minimum((np.arange(width) * w) // width, w - 1)
    return a[ys[:, None], xs]


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each new pixel is the mean of the area that it covers, parts of pixels included."""

    def weights(n: int, m: int) -> np.ndarray:
        out, step = np.zeros((m, n)), n / m
        for i in range(m):
            low, high = i * step, (i + 1) * step
            for k in range(int(low), min(n, math.ceil(high - 1e-9))):
                out[i, k] = (min(high, k + 1) - max(low, k)) / step
        return out

    h, w = a.shape
    return np.floor(weights(h, height) @ a.astype(np.float64) @ weights(w, width).T + 0.5).astype(np.uint8)


def gaussian(size: int) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - (size - 1) / 2
    w = np.exp(-(x * x) / (2 * sigma * sigma))
    return w / w.sum()


def adaptive_threshold(image: np.ndarray, block: int = 31, c: float = 7) -> np.ndarray:
    """True where a pixel is darker than the Gaussian mean around it by at least floor(c); edges are repeated."""
    if block < 3 or block % 2 == 0:
        raise ValueError("block size must be odd and at least 3")
    w, r = gaussian(block), block // 2
    padded = np.pad(image.astype(np.float64), r, mode="edge")
    rows = sum(w[k] * padded[:, k : k + image.shape[1]] for k in range(block))
    mean = np.rint(sum(w[k] * rows[k : k + image.shape[0]] for k in range(block)))
    return image.astype(np.int64) - mean <= -math.floor(c)


def inside_polygon(points: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Whether cells lie in a closed polygon, its edges included."""
    inside, edge = np.zeros(np.broadcast(xs, ys).shape, bool), np.zeros(np.broadcast(xs, ys).shape, bool)
    n = len(points)
    for i in range(n):
        (x1, y1), (x2, y2) = points[i], points[(i + 1) % n]
        cross = (x2 - x1) * (ys - y1) - (y2 - y1) * (xs - x1)
        within = (xs >= min(x1, x2)) & (xs <= max(x1, x2)) & (ys >= min(y1, y2)) & (ys <= max(y1, y2))
        edge |= (cross == 0) & within
        if y1 != y2:
            upward = y2 > y1
            between = (ys >= min(y1, y2)) & (ys < max(y1, y2))
            inside ^= between & ((cross > 0) if upward else (cross < 0))
    return inside | edge


def crop_polygon(image: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, tuple[int, int]]:
    """The polygon's bounding box cut out, white outside the polygon, and the box's corner."""
    p = np.rint(np.asarray(points, np.float64)).astype(np.int64)
    (x0, y0), (x1, y1) = p.min(0), p.max(0)
    if x1 - x0 < 1 or y1 - y0 < 1:
        raise ValueError("the region of interest is empty")
    out = image[y0 : y1 + 1, x0 : x1 + 1].copy()
    ys, xs = np.mgrid[y0 : y0 + out.shape[0], x0 : x0 + out.shape[1]]
    out[~inside_polygon(p, xs, ys)] = 255
    return out, (int(x0), int(y0))


def find(root: np.ndarray, a: int) -> int:
    while root[a] != a:
        root[a] = root[root[a]]
        a = root[a]
    return a


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected components: 0 is background, labels follow their first pixels in row order."""
    h, w = mask.shape
    runs, root_list, before = [], [], []
    for y in range(h):
        edge = np.flatnonzero(np.diff(np.r_[0, mask[y].astype(np.int8), 0]))
        now = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            k = len(runs)
            runs.append((y, a, b))
            root_list.append(k)
            for a2, b2, j in before:
                if a2 <= b and b2 >= a:
                    i, j = _find(root_list, k), _find(root_list, j)
                    root_list[max(i, j)] = min(i, j)
            now.append((a, b, k))
        before = now
    out, names = np.zeros((h, w), np.int32), {}
    for k, (y, a, b) in enumerate(runs):
        out[y, a:b] = names.setdefault(_find(root_list, k), len(names) + 1)
    return out


def _find(root: list[int], a: int) -> int:
    while root[a] != a:
        root[a] = root[root[a]]
        a = root[a]
    return a


def stats(labels: np.ndarray) -> list[dict]:
    """Of each component: left, top, width, height, area, and its centroid."""
    ys, xs = np.nonzero(labels)
    own, n = labels[ys, xs], int(labels.max(initial=0))
    area = np.bincount(own, minlength=n + 1)
    out = []
    order = np.argsort(own, kind="stable")
    at = np.searchsorted(own[order], np.arange(1, n + 2))
    for k in range(1, n + 1):
        part = order[at[k - 1] : at[k]]
        x, y = xs[part], ys[part]
        out.append({"label": k, "left": int(x.min()), "top": int(y.min()), "width": int(x.max() - x.min() + 1), "height": int(y.max() - y.min() + 1), "area": int(area[k]), "cx": float(x.mean()), "cy": float(y.mean())})
    return out


def thin(mask: np.ndarray) -> np.ndarray:
    """Zhang and Suen's thinning; pixels on the image's border stay."""
    a = mask.astype(np.uint8).copy()
    while True:
        changed = False
        for step in (0, 1):
            p = np.pad(a, 1)
            n = [p[:-2, 1:-1], p[:-2, 2:], p[1:-1, 2:], p[2:, 2:], p[2:, 1:-1], p[2:, :-2], p[1:-1, :-2], p[:-2, :-2]]
            count = sum(x.astype(np.int8) for x in n)
            turns = sum(((n[k] == 0) & (n[(k + 1) % 8] == 1)).astype(np.int8) for k in range(8))
            first, second = ((n[0] * n[2] * n[4], n[2] * n[4] * n[6]) if step == 0 else (n[0] * n[2] * n[6], n[0] * n[4] * n[6]))
            drop = (a == 1) & (count >= 2) & (count <= 6) & (turns == 1) & (first == 0) & (second == 0)
            drop[0] = drop[-1] = False
            drop[:, 0] = drop[:, -1] = False
            if drop.any():
                a[drop] = 0
                changed = True
        if not changed:
            return a.astype(bool)


#: The steps of a 5 x 5 distance mask, straight, diagonal and knight's move.
CHAMFER = (1.0, 1.4, 2.1969)


def chamfer(mask: np.ndarray) -> np.ndarray:
    """Distance to the nearest cell that isn't set, over steps of the 5 x 5 mask, in two passes over the rows."""
    a, b, c = CHAMFER
    h, w = mask.shape
    far = 1e6
    d = np.full((h + 4, w + 4), far)
    d[2:-2, 2:-2] = np.where(mask, far, 0.0)
    above = [(-1, 0, a), (-1, -1, b), (-1, 1, b), (-2, -1, c), (-2, 1, c), (-1, -2, c), (-1, 2, c)]

    def sweep(ys, sign):
        for y in ys:
            row = d[y, 2:-2]
            for dy, dx, cost in above:
                row = np.minimum(row, d[y + sign * dy, 2 + dx : 2 + dx + w] + cost)
            # along the row: a running minimum of (value - position)
            line = row - np.arange(w) * a
            row = np.minimum.accumulate(line) + np.arange(w) * a
            line = row[::-1] - np.arange(w) * a
            d[y, 2:-2] = (np.minimum.accumulate(line) + np.arange(w) * a)[::-1]

    sweep(range(2, h + 2), 1)
    sweep(range(h + 1, 1, -1), -1)
    return d[2:-2, 2:-2]


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull of whole points, in order around it; points on its edges are no corners."""
    p = np.unique(np.asarray(points, np.int64), axis=0)
    if len(p) < 3:
        return p
    halves = []
    for line in (p, p[::-1]):
        half: list[np.ndarray] = []
        for q in line:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (q[1] - half[-2][1]) - (half[-1][1] - half[-2][1]) * (q[0] - half[-2][0]) <= 0:
                half.pop()
            half.append(q)
        halves += half[:-1]
    return np.array(halves)


def polygon_area(p: np.ndarray) -> float:
    x, y = p[:, 0].astype(np.float64), p[:, 1].astype(np.float64)
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def polygon_perimeter(p: np.ndarray) -> float:
    return float(np.hypot(*(p - np.roll(p, -1, axis=0)).T.astype(np.float64)).sum())


def simplify(p: np.ndarray, epsilon: float) -> np.ndarray:
    """Douglas and Peucker on a closed polygon, split at its two corners farthest apart (the first such pair)."""
    n = len(p)
    if n < 4:
        return p
    q = p.astype(np.float64)
    gap = ((q[:, None] - q[None]) ** 2).sum(-1)
    i, j = divmod(int(np.argmax(gap)), n)
    keep = {i, j}
    todo = [[(i + k) % n for k in range((j - i) % n + 1)], [(j + k) % n for k in range((i - j) % n + 1)]]
    while todo:
        arc = todo.pop()
        if len(arc) < 3:
            continue
        a, b = q[arc[0]], q[arc[-1]]
        size = float(np.hypot(*(b - a)))
        inner = q[arc[1:-1]] - a
        d = np.abs((b - a)[0] * inner[:, 1] - (b - a)[1] * inner[:, 0]) / size if size else np.hypot(*inner.T)
        k = int(np.argmax(d)) + 1
        if d[k - 1] > epsilon:
            keep.add(arc[k])
            todo += [arc[: k + 1], arc[k:]]
    out = p[sorted(keep)]
    return out if len(out) >= 3 else p


def fill_polygon(shape: tuple[int, int], p: np.ndarray) -> np.ndarray:
    out = np.zeros(shape, bool)
    (x0, y0), (x1, y1) = np.maximum(p.min(0), 0), np.minimum(p.max(0), (shape[1] - 1, shape[0] - 1))
    if x1 >= x0 and y1 >= y0:
        ys, xs = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
        out[y0 : y1 + 1, x0 : x1 + 1] = inside_polygon(p, xs, ys)
    return out


def draw_line(out: np.ndarray, a: tuple[int, int], b: tuple[int, int], value=True) -> None:
    """An 8-connected line, one pixel wide."""
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
    t = np.linspace(0, 1, n + 1) if n else np.zeros(1)
    xs = np.floor(a[0] + (b[0] - a[0]) * t + 0.5).astype(int)
    ys = np.floor(a[1] + (b[1] - a[1]) * t + 0.5).astype(int)
    ok = (xs >= 0) & (ys >= 0) & (xs < out.shape[1]) & (ys < out.shape[0])
    out[ys[ok], xs[ok]] = value


def draw_polygon(shape: tuple[int, int], p: np.ndarray) -> np.ndarray:
    out = np.zeros(shape, bool)
    for k in range(len(p)):
        draw_line(out, tuple(p[k]), tuple(p[(k + 1) % len(p)]))
    return out


def two_sided(candidate: np.ndarray, white: np.ndarray, distance: np.ndarray, probe: float, angles: int, low: float, high: float) -> np.ndarray:
    """Candidates that see white on both sides, at some angle, at a reach in proportion to their distance."""
    out = np.zeros_like(candidate)
    ys, xs = np.nonzero(candidate)
    if len(xs) == 0:
        return out
    reach = np.clip(distance[ys, xs] * probe, low, high)
    hit = np.zeros(len(xs), bool)
    h, w = candidate.shape
    for k in range(angles):
        u = math.pi * k / angles
        dx, dy = np.rint(reach * math.cos(u)).astype(int), np.rint(reach * math.sin(u)).astype(int)
        see = lambda s: white[np.clip(ys + s * dy, 0, h - 1), np.clip(xs + s * dx, 0, w - 1)]
        hit |= see(1) & see(-1)
    out[ys[hit], xs[hit]] = True
    return out


def centreline(gray_image: np.ndarray, scale: float = 0.25, min_radius: float = 6, max_radius: float = 80, probe: float = 1.35, angles: int = 8, reconnect: int = 35) -> np.ndarray:
    """The middle of dark bands between white regions: thinned at a smaller scale, probed, reconnected, scaled back."""
    if not 0 < scale <= 1:
        raise ValueError("scale must be above 0 and at most 1")
    if angles < 4:
        raise ValueError("at least 4 probe angles are needed")
    h, w = gray_image.shape
    small = area_resize(gray_image, max(1, int(np.rint(h * scale))), max(1, int(np.rint(w * scale)))) if scale < 1 else gray_image
    dark = small <= 127
    low, high = max(2.0, min_radius * scale), max(3.0, max_radius * scale)
    d = chamfer(dark)
    candidate = thin(dark) & (d >= low) & (d <= high)
    seeds = two_sided(candidate, ~dark, d, probe, angles, max(5.0, low), max(6.0, high))
    k = max(3, int(np.rint(reconnect * scale)))
    near = dilate(seeds, ellipse(k + 1 if k % 2 == 0 else k))
    return nearest_resize(candidate & near, h, w)


def hough_segments(mask: np.ndarray, threshold: int = 80, min_length: float = 160, max_gap: float = 80) -> list[tuple[int, int, int, int]]:
    """Straight runs of set pixels, found without chance: votes by (degree, distance), strongest first.

    A peak's pixels, in order along its line, are cut at gaps above max_gap; runs of min_length and more are told and
    their pixels don't vote again.
    """
    ys, xs = np.nonzero(mask)
    left = np.ones(len(xs), bool)
    angles = np.deg2rad(np.arange(180))
    normal = np.stack([np.cos(angles), np.sin(angles)])
    rho = np.rint(np.stack([xs, ys], 1) @ normal).astype(int) if len(xs) else np.zeros((0, 180), int)
    span = int(np.hypot(*mask.shape)) + 1
    out = []
    votes = np.zeros((180, 2 * span + 1), np.int64)
    for k in range(180):
        np.add.at(votes[k], rho[:, k] + span, 1)
    while True:
        k, r = divmod(int(np.argmax(votes)), votes.shape[1])
        if votes[k, r] < threshold:
            return out
        own = np.flatnonzero(left & (np.abs(rho[:, k] - (r - span)) <= 1))
        t = -xs[own] * math.sin(angles[k]) + ys[own] * math.cos(angles[k])
        order = np.argsort(t, kind="stable")
        cut = np.flatnonzero(np.diff(t[order]) > max_gap) + 1
        told = False
        for part in np.split(order, cut):
            if len(part) and t[part[-1]] - t[part[0]] >= min_length:
                a, b = own[part[0]], own[part[-1]]
                out.append((int(xs[a]), int(ys[a]), int(xs[b]), int(ys[b])))
                gone = own[part]
                left[gone] = False
                for j in range(180):
                    np.subtract.at(votes[j], rho[gone, j] + span, 1)
                told = True
        if not told:
            votes[k, r] = -1


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest pairing of rows with columns, as many as the smaller side has; O(n^3) by shortest paths."""
    c = np.asarray(cost, np.float64)
    if c.size == 0:
        return []
    if c.shape[0] > c.shape[1]:
        return sorted((a, b) for b, a in assignment(c.T))
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[at] = True
            row = owner[at]
            free = ~used[1:]
            now = c[row - 1] - u[row] - v[1:]
            better = free & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], at
            nxt = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            step = least[nxt]
            u[owner[used]] += step
            v[used] -= step
            least[1:][free] -= step
            at = nxt
            if owner[at] == 0:
                break
        while at:
            owner[at] = owner[way[at]]
            at = way[at]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])
