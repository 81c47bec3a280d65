"""Parameters of the pipeline, with their rules, and two presets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Roi:
    base_width: int = 5472
    base_height: int = 3648
    points: tuple[float, ...] = (1689, 201, 3214, 228, 3180, 2445, 1584, 2382)

    def __post_init__(self):
        _need(self.base_width > 0 and self.base_height > 0, "base sizes must be positive")
        _need(len(self.points) == 8, "a region of interest has 8 numbers")


@dataclass(frozen=True)
class Holes:
    block: int = 31
    c: float = 7
    clean: int = 6
    merge: int = 5
    min_area: float = 6
    max_area: float = 120
    max_aspect: float = 1.8
    min_fill: float = 0.5
    discard_border: bool = False

    def __post_init__(self):
        _need(self.block % 2 == 1 and self.block > 0, "the block size must be odd and positive")
        _need(self.clean > 0 and self.merge > 0, "kernel sizes must be positive")
        _need(0 <= self.min_area <= self.max_area, "areas must be ordered")
        _need(self.max_aspect > 0 and 0 <= self.min_fill <= 1, "aspect must be positive and fill a share")


#: The filter of centres taken from a finished mask.
STANDALONE_CENTRES = {"min_area": 2, "max_area": 200, "max_aspect": 3.0, "min_fill": 0.2}


@dataclass(frozen=True)
class Boundary:
    min_r: float = 0.70
    max_r: float = 1.55
    min_points: int = 4
    hull_area: float = 0.20
    eps: float = 0.10
    eps_min: float = 1.0
    poly_eps: float = 0.0035

    def __post_init__(self):
        _need(0 < self.min_r < self.max_r, "radius shares must be positive and ordered")
        _need(self.min_points > 0, "the least number of points must be positive")
        _need(min(self.hull_area, self.eps, self.eps_min, self.poly_eps) >= 0, "tolerances can't be negative")


@dataclass(frozen=True)
class Output:
    kind: str = "line"
    band_px: int = 0
    band_ratio: float = 0.18
    kernel: str = "ellipse"
    style: str = "black_on_white"
    frame: int = 0

    def __post_init__(self):
        _need(self.kind in ("line", "band", "instances"), "kind must be line, band or instances")
        _need(self.kernel in ("ellipse", "rect", "cross"), "kernel must be ellipse, rect or cross")
        _need(self.style in ("black_on_white", "white_on_black"), "style must be black_on_white or white_on_black")
        _need(self.band_px >= 0 and self.frame >= 0 and self.band_ratio > 0, "widths can't be negative")


@dataclass(frozen=True)
class Centreline:
    scale: float = 0.25
    min_radius: float = 6
    max_radius: float = 80
    probe: float = 1.35
    angles: int = 8
    reconnect: int = 35

    def __post_init__(self):
        _need(0 < self.scale <= 1, "the scale must be above 0 and at most 1")
        _need(self.angles >= 4, "at least 4 probe angles are needed")
        _need(self.min_radius < self.max_radius, "band radii must be ordered")


@dataclass(frozen=True)
class Geometry:
    inset: int = 28
    votes: int = 80
    min_length: float = 160
    max_gap: float = 80
    rho: float = 55
    pad: float = 120
    min_segment: float = 80
    min_black: float = 0.45
    thickness: int = 2
    draw_inner_rect: bool = False


@dataclass(frozen=True)
class Compare:
    degree_penalty: float = 20.0


@dataclass(frozen=True)
class Params:
    image_scale: float = 1.0
    preview_dilate: int = 1
    roi: Roi = field(default_factory=Roi)
    holes: Holes = field(default_factory=Holes)
    boundary: Boundary = field(default_factory=Boundary)
    output: Output = field(default_factory=Output)
    centreline: Centreline = field(default_factory=Centreline)
    geometry: Geometry = field(default_factory=Geometry)
    compare: Compare = field(default_factory=Compare)

    def __post_init__(self):
        _need(self.image_scale > 0 and self.preview_dilate > 0, "scales must be positive")


LARGE = Params()
SMALL = replace(LARGE, roi=Roi(898, 969, (0, 0, 897, 0, 897, 968, 0, 968)), holes=Holes(clean=3), output=Output(kind="band"))
STANDALONE_BOUNDARY = Boundary(min_r=0.55, max_r=1.65)
PRESETS = {"large": LARGE, "small": SMALL}
