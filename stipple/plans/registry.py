"""Registered queries over the derived relations, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.functions.kernels import element, gaussian, offsets
from stipple.functions.scalars import gray, report_line
from stipple.operators import compare, draw, lines, pixels, points, series
from stipple.plans import fixtures as fx

N = fx.SIZE
ROI = [(3, 5), (58, 2), (61, 60), (6, 55)]
RECT = dict(left=50, top=74, right=1580, bottom=2190)


def cte(*parts: str, **more: str) -> str:
    """WITH clauses for relations by name, then further ones."""
    named = {n: fx.SQL[n] for n in parts} | more
    return "with recursive " + ", ".join(f"{n} as ({q})" for n, q in named.items()) + " "


MASK = "select image_id, x, y from pixels where v > 25"


def steps_sql(k: int, shape: str = "ellipse", sign: int = 1) -> str:
    return "values " + ", ".join(f"({sign * dx}, {sign * dy})" for dx, dy in offsets(element(k, shape)))


def dilate_sql(src: str, k: int, shape: str = "ellipse") -> str:
    return f"select distinct m.image_id, m.x - s.dx as x, m.y - s.dy as y from {src} m, ({steps_sql(k, shape)}) s(dx, dy) where m.x - s.dx between 0 and {N - 1} and m.y - s.dy between 0 and {N - 1}"


def erode_sql(src: str, k: int, shape: str = "ellipse") -> str:
    """By its definition: no cell of the kernel that lies in the image is unset."""
    cells = f"select distinct c.image_id, c.x, c.y from (select m.image_id, m.x - s.dx as x, m.y - s.dy as y from {src} m, ({steps_sql(k, shape)}) s(dx, dy)) c where c.x between 0 and {N - 1} and c.y between 0 and {N - 1}"
    return f"""select c.image_id, c.x, c.y from ({cells}) c where not exists (select 1 from ({steps_sql(k, shape)}) s(dx, dy) where c.x + s.dx between 0 and {N - 1} and c.y + s.dy between 0 and {N - 1}
        and not exists (select 1 from {src} m where m.image_id = c.image_id and m.x = c.x + s.dx and m.y = c.y + s.dy))"""


LABELS = """select image_id, x, y, min(label) as label from reach group by all"""
#: Every set pixel with the codes of all pixels that it can reach.
REACH = """select image_id, x, y, y * 2147483648 + x as label from mask union
    select m.image_id, m.x, m.y, r.label from reach r join mask m on m.image_id = r.image_id and m.x between r.x - 1 and r.x + 1 and m.y between r.y - 1 and r.y + 1"""
STATS = """select image_id, label, min(x) as "left", min(y) as "top", max(x) - min(x) + 1 as width, max(y) - min(y) + 1 as height, count(*) as area, avg(x) as cx, avg(y) as cy from labels group by 1, 2"""
FEATURES = """select *, greatest(width, height) / greatest(1, least(width, height)) as aspect, area / greatest(1, width * height) as fill from stats"""
KEPT = "select * from features where area between 2 and 120 and aspect <= 1.8 and fill >= 0.5"


def regions(*more: str) -> str:
    names = {"mask": MASK, "reach": REACH, "labels": LABELS, "stats": STATS, "features": FEATURES, "kept": KEPT}
    return cte("pixels", **names)


def labels(spark: SparkSession, d: str) -> DataFrame:
    return pixels.components(fx.mask(spark, d))


def features(spark: SparkSession, d: str) -> DataFrame:
    return pixels.region_features(pixels.region_stats(labels(spark, d)))


def kept(spark: SparkSession, d: str) -> DataFrame:
    return pixels.region_filter(features(spark, d), min_area=2)


# ---- points

NEIGHBOURS = "select a.image_id, a.pid, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as d from points a join points b on a.image_id = b.image_id and a.pid <> b.pid group by 1, 2"
SPACING = "select image_id, median(d) as spacing from neighbours group by 1"
EDGES = "select a.image_id, a.pid as u, b.pid as v, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d from points a join points b on a.image_id = b.image_id and a.pid < b.pid join spacings s on s.image_id = a.image_id where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) between s.spacing * 0.70 and s.spacing * 1.55"
BOTH = "select image_id, u, v from edges union all select image_id, v, u from edges"
WALK = "select image_id, u as pid, u as comp_id from both_ways union select b.image_id, b.v, w.comp_id from walk w join both_ways b on b.image_id = w.image_id and b.u = w.pid"
MEMBERS = "select image_id, min(comp_id) as comp_id, pid from walk group by image_id, pid"
GROUPS = {"neighbours": NEIGHBOURS, "spacings": SPACING, "edges": EDGES, "both_ways": BOTH, "walk": WALK, "members": MEMBERS}
#: Sides of hulls: directed pairs of corners with nothing to their right, and nothing in line beyond them.
SIDES = """select a.image_id, a.comp_id, a.x as ax, a.y as ay, b.x as bx, b.y as by_ from corners a join corners b on a.image_id = b.image_id and a.comp_id = b.comp_id and (a.x <> b.x or a.y <> b.y)
    where not exists (select 1 from corners c where c.image_id = a.image_id and c.comp_id = a.comp_id and ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
    or ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 and (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 0)))"""
CORNERS = "select distinct m.image_id, m.comp_id, round_even(p.x, 0)::bigint as x, round_even(p.y, 0)::bigint as y from members m join points p on p.image_id = m.image_id and p.pid = m.pid join (select image_id, comp_id from members group by 1, 2 having count(*) >= 4) g on g.image_id = m.image_id and g.comp_id = m.comp_id"
HULLS = """select h.image_id, h.comp_id, round(abs(sum(ax * by_ - bx * ay)) / 2.0, 6) as area, round(sum(sqrt((ax - bx) ** 2 + (ay - by_) ** 2)), 6) as perimeter from sides h group by 1, 2"""


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = fx.points(spark, d)
    s = points.spacing(points.nearest_neighbours(p))
    return p, s, points.annulus_edges(p, s)


def hulls(spark: SparkSession, d: str) -> DataFrame:
    p, s, e = graph(spark, d)
    return points.hulls(points.point_components(e), p, s)


# ---- lines

def graph_sql(table: str = "lines", rect: dict[str, int] = RECT, pad: int = 120, reach: int = 820, gap: int = 10, edge: int = 35, segment: int = 80, black: float | None = None) -> dict[str, str]:
    """Crossings, boundary nodes and segments of lines in a rect; with a share of black of the pixels if that is given."""
    left, right, top, bottom = (rect[c] for c in ("left", "right", "top", "bottom"))

    def dark(x0: str, y0: str, x1: str, y1: str, of: str) -> str:
        """By its definition: samples at most 6 apart, at least two."""
        if black is None:
            return ""
        n = f"greatest(2, ceil(sqrt(({x1} - {x0}) ** 2 + ({y1} - {y0}) ** 2) / 6.0)::bigint)"
        at = lambda a, b: f"least(greatest(round_even({a} + ({b} - {a}) * (i / ({n} - 1)), 0), 0), {N - 1})::bigint"
        return f" and (select count(p.v) / count(*) from (select {at(x0, x1)} as px, {at(y0, y1)} as py, {of}.image_id as own from unnest(range({n})) u(i)) s left join pixels p on p.image_id = s.own and p.x = s.px and p.y = s.py and p.v > 10) >= {black}"

    cross = f"""select image_id, 'C' || (row_number() over (partition by image_id order by line_a, line_b) - 1) as node_id, line_a, line_b, x, y, ta, tb from (
    select *, aox + ta * adx as x, aoy + ta * ady as y from (
    select a.image_id, a.line_id as line_a, b.line_id as line_b, a.ox as aox, a.oy as aoy, a.dx as adx, a.dy as ady, a.tmin as atmin, a.tmax as atmax, b.tmin as btmin, b.tmax as btmax,
    (b.dx * (b.oy - a.oy) - (b.ox - a.ox) * b.dy) / (b.dx * a.dy - a.dx * b.dy) as ta, (a.dx * (b.oy - a.oy) - (b.ox - a.ox) * a.dy) / (b.dx * a.dy - a.dx * b.dy) as tb
    from {table} a join {table} b on a.image_id = b.image_id and a.line_id < b.line_id and a.family <> b.family where abs(b.dx * a.dy - a.dx * b.dy) >= 1e-6))
    where aox + ta * adx between {left} and {right} and aoy + ta * ady between {top} and {bottom} and ta between atmin - {pad} and atmax + {pad} and tb between btmin - {pad} and btmax + {pad}"""
    raw_hits = f"""select image_id, line_id, 0 as ord, {left}::double as x, oy + ({left} - ox) / dx * dy as y, ({left} - ox) / dx as t from {table} where oy + ({left} - ox) / dx * dy between {top - 1} and {bottom + 1}
    union all select image_id, line_id, 1, {right}, oy + ({right} - ox) / dx * dy, ({right} - ox) / dx from {table} where oy + ({right} - ox) / dx * dy between {top - 1} and {bottom + 1}
    union all select image_id, line_id, 2, ox + ({top} - oy) / dy * dx, {top}, ({top} - oy) / dy from {table} where ox + ({top} - oy) / dy * dx between {left - 1} and {right + 1}
    union all select image_id, line_id, 3, ox + ({bottom} - oy) / dy * dx, {bottom}, ({bottom} - oy) / dy from {table} where ox + ({bottom} - oy) / dy * dx between {left - 1} and {right + 1}"""
    # Of two hits within 2 of each other the first stays; a line has two apart at most, so no chains arise.
    hits = "select h.* from raw_hits h where not exists (select 1 from raw_hits g where g.image_id = h.image_id and g.line_id = h.line_id and g.ord < h.ord and (g.x - h.x) ** 2 + (g.y - h.y) ** 2 < 4)"
    on = "select image_id, line_a as line_id, node_id, 'crossing' as kind, substr(node_id, 2)::bigint as n, x, y, ta as t from crossed union all select image_id, line_b, node_id, 'crossing', substr(node_id, 2)::bigint, x, y, tb from crossed"
    # The first hit is judged by the crossings (or the extent), the second also by the first if that was taken.
    first = """select h.*, row_number() over (partition by h.image_id, h.line_id order by h.ord) as pos, c.x as cx, c.y as cy, c.t as ct from hits h left join lateral
    (select o.x, o.y, o.t from on_lines o where o.image_id = h.image_id and o.line_id = h.line_id order by abs(o.t - h.t), o.n limit 1) c on true"""
    taken = f"""select f.*, case when f.ct is not null then sqrt((f.cx - f.x) ** 2 + (f.cy - f.y) ** 2) >= {gap}{dark("f.x", "f.y", "f.cx", "f.cy", "f")} else f.t between -{reach} and {reach} end as alone from judged f"""
    accepted = f"""select b.image_id, b.line_id, b.ord, b.x, b.y, b.t from taken b left join taken a on a.image_id = b.image_id and a.line_id = b.line_id and a.pos = b.pos - 1 and a.alone
    where case when a.t is null then b.alone when b.ct is not null and abs(b.ct - b.t) <= abs(a.t - b.t) then sqrt((b.cx - b.x) ** 2 + (b.cy - b.y) ** 2) >= {gap}{dark('b.x', 'b.y', 'b.cx', 'b.cy', 'b')} else sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) >= {gap}{dark('b.x', 'b.y', 'a.x', 'a.y', 'b')} end"""
    bound = "select a.image_id, a.line_id, row_number() over (partition by a.image_id order by a.line_id, a.ord) - 1 + coalesce(c.n, 0) as n, a.x, a.y, a.t from accepted a left join (select image_id, count(*) as n from crossed group by 1) c on c.image_id = a.image_id"
    nodes = "select image_id, line_id, node_id, kind, n, x, y, t from on_lines union all select image_id, line_id, 'B' || n, 'boundary', n, x, y, t from bound"
    pairs = """select *, lead(node_id) over w as to_id, lead(kind) over w as to_kind, lead(x) over w as tx, lead(y) over w as ty, row_number() over w as pos from all_nodes window w as (partition by image_id, line_id order by t, n)"""
    long = f"""select *, sqrt((x - tx) ** 2 + (y - ty) ** 2) as size from pairs where to_id is not null and sqrt((x - tx) ** 2 + (y - ty) ** 2) >= case when kind = 'boundary' or to_kind = 'boundary' then {edge} else {segment} end{dark('x', 'y', 'tx', 'ty', 'pairs')}"""
    once = """select * from long_ones qualify row_number() over (partition by image_id, least(node_id, to_id), greatest(node_id, to_id) order by line_id, pos) = 1"""
    return {"crossed": cross, "raw_hits": raw_hits, "hits": hits, "on_lines": on, "judged": first, "taken": taken, "accepted": accepted, "bound": bound, "all_nodes": nodes, "pairs": pairs, "long_ones": long, "once": once}


GRAPH = graph_sql()
SMALL_RECT = dict(left=2, top=3, right=60, bottom=61)
SMALL = graph_sql("small_lines", SMALL_RECT, 10, 50, 3, 4, 6, 0.1)


def dark_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and segments of lines across the pictures, tested on their pixels."""
    ln, rect = fx.small_lines(spark, d), fx.rects(spark, d, tuple(SMALL_RECT.values()))
    black = fx.mask(spark, d, 10).withColumns({"w": F.lit(N), "h": F.lit(N)})
    crossed = lines.crossings(ln, rect, pad=10)
    nodes = lines.line_nodes(ln, crossed, lines.rect_hits(ln, rect), 3, 10, black, 0.1)
    return nodes, lines.line_segments(nodes, 6, black, 0.1, 4)


def line_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ln, rect = fx.lines(spark, d), fx.rects(spark, d)
    crossed = lines.crossings(ln, rect)
    nodes = lines.line_nodes(ln, crossed, lines.rect_hits(ln, rect))
    return ln, crossed, nodes


FIT = """select image_id, fam, count(*) // 2 as support_count, avg(x) as ox, avg(y) as oy, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) as a, sum(l) as support from ends group by 1, 2"""
ENDS = """select image_id, seg_no % 2 as fam, x1::double as x, y1::double as y, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) as l from hough union all select image_id, seg_no % 2, x2::double, y2::double, 0.0 from hough"""


def fitted(spark: SparkSession, d: str) -> DataFrame:
    segs = fx.hough(spark, d)
    size = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    own = segs.select("image_id", (F.col("seg_no") % 2).alias("family"), F.lit(0).cast("long").alias("cluster"), F.when(F.col("seg_no") % 2 == 0, 0.5).otherwise(-0.8).alias("hx"), F.when(F.col("seg_no") % 2 == 0, 0.87).otherwise(0.6).alias("hy"), "x1", "y1", "x2", "y2", size.alias("length"))
    return lines.fit_lines(own)


# ---- comparison

DEGREES = "select n.*, coalesce(e.c, 0) as degree from nodes n left join (select image_id, node_id, count(*) as c from (select image_id, from_node as node_id from segments union all select image_id, to_node from segments) group by 1, 2) e on e.image_id = n.image_id and e.node_id = n.node_id"
MOVES = "select t.image_id, t.kind, coalesce(avg(t.x) - (select avg(x) from nodes r where r.image_id = 1 and r.kind = t.kind), 0) as tx, coalesce(avg(t.y) - (select avg(y) from nodes r where r.image_id = 1 and r.kind = t.kind), 0) as ty from nodes t where t.image_id <> 1 group by 1, 2"
COSTS = "select t.image_id, t.kind, r.node_id as ref_node, t.node_id as tgt_node, sqrt((r.x + m.tx - t.x) ** 2 + (r.y + m.ty - t.y) ** 2) + 20 * abs(r.degree - t.degree) as cost from degrees t join moves m on m.image_id = t.image_id and m.kind = t.kind join degrees r on r.image_id = 1 and r.kind = t.kind where t.image_id <> 1"
#: Nodes of the smaller side (of the reference, if both are equal) and of the other, counted from 0.
RANKED = "select image_id, kind, dense_rank() over (partition by image_id, kind order by length(ref_node), ref_node) - 1 as r, dense_rank() over (partition by image_id, kind order by length(tgt_node), tgt_node) - 1 as t, cost from costs"
NUMBERED = "select image_id, kind, case when max(t) over w < max(r) over w then t else r end as i, case when max(t) over w < max(r) over w then r else t end as j, cost from ranked window w as (partition by image_id, kind)"


def subsets_sql(n: int = 8) -> dict[str, str]:
    """The cheapest assignment by dynamic programming over subsets of columns, one clause for each row."""
    out = {"s0": "select distinct image_id, kind, 0 as seen, 0.0::double as cost from numbered"}
    for i in range(n):
        out[f"s{i + 1}"] = f"select s.image_id, s.kind, s.seen | (1 << c.j::int) as seen, min(s.cost + c.cost) as cost from s{i} s join numbered c on c.image_id = s.image_id and c.kind = s.kind and c.i = {i} where s.seen & (1 << c.j::int) = 0 group by 1, 2, 3"
    every = " union all ".join(f"select image_id, kind, {i} as n, cost from s{i}" for i in range(n + 1))
    out["cheapest"] = f"select image_id, kind, max(n) as n_pairs, min(cost) filter (where n = top) as total from (select *, max(n) over (partition by image_id, kind) as top from ({every})) group by 1, 2"
    return out


GEOMETRY = "select *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) as size, degrees(atan2(y1 - y0, x1 - x0)) as angle, (x0 + x1) / 2.0 as mx, (y0 + y1) / 2.0 as my from segments"
#: In these graphs the nodes of one place are each other's match.
MATCHED = """select t.image_id, r.seg_id as ref_segment, t.seg_id as target_segment, r.size as rs, t.size as ts, 180 - (((180 - (t.angle - r.angle)) % 360) + 360) % 360 as turn, r.mx as rmx, r.my as rmy, t.mx as tmx, t.my as tmy
    from geometry r join geometry t on r.image_id = 1 and t.image_id <> 1 and least(r.from_node, r.to_node) = least(t.from_node, t.to_node) and greatest(r.from_node, r.to_node) = greatest(t.from_node, t.to_node)"""


def twice(e: str) -> str:
    """To six places as the operator gives them, then to four."""
    return f"round(round_even({e}, 6), 4)"


MOVED = f"""select image_id, ref_segment, target_segment, {twice('turn')} as rotation_deg, {twice('tmx - rmx')} as mid_x, {twice('tmy - rmy')} as mid_y,
    {twice('tmx - (cos(radians(turn)) * rmx - sin(radians(turn)) * rmy)')} as rigid_x, {twice('tmy - (sin(radians(turn)) * rmx + cos(radians(turn)) * rmy)')} as rigid_y, {twice('ts / greatest(rs, 1e-9)')} as length_ratio from matched"""


def graphs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return fx.nodes(spark, d), fx.segments(spark, d)


def same_place(nodes: DataFrame) -> DataFrame:
    return nodes.filter("image_id <> 1").select("image_id", "kind", F.col("node_id").alias("ref_node"), F.col("node_id").alias("tgt_node"), F.lit(0.0).alias("cost"))


def moved(spark: SparkSession, d: str) -> DataFrame:
    n, s = graphs(spark, d)
    return compare.transforms(compare.match_segments(s, same_place(n), 1))


def assigned(spark: SparkSession, d: str) -> DataFrame:
    n, s = graphs(spark, d)
    return compare.match_nodes(n, s, 1)


Entry = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def registry() -> dict[str, Entry]:
    r6, r4 = (lambda c: F.round(c, 6)), (lambda c: F.round(c, 4))
    px, mask = fx.pixels, fx.mask
    blur = gaussian(5).tolist()
    turns = [(k, math.cos(math.radians(k)), math.sin(math.radians(k))) for k in range(0, 180, 15)]
    sees = [(k, math.cos(math.pi * k / 4), math.sin(math.pi * k / 4)) for k in range(4)]
    out: dict[str, Entry] = {}

    def add(name: str, f, sql: str | None) -> None:
        out[name] = (f, sql)

    # pixels
    add("pixel_threshold", lambda s, d: pixels.threshold(px(s, d), 25), cte("pixels") + "select image_id, x, y, case when v > 25 then 255 else 0 end as v from pixels")
    add("pixel_binarise", lambda s, d: pixels.binarise(px(s, d).withColumn("v", F.col("v") * 5)), cte("pixels") + "select image_id, x, y, v * 5 < 128 as black, v * 5 > 127 as white from pixels")
    add("mask_invert", lambda s, d: pixels.invert(px(s, d)), cte("pixels") + "select image_id, x, y, 255 - v as v from pixels")
    add("hole_preview", lambda s, d: pixels.paint(px(s, d), mask(s, d, 40)), cte("pixels") + "select image_id, x, y, case when v > 40 then 255 else v end as v from pixels")
    add("gray_level", lambda s, d: px(s, d).select("image_id", "x", "y", gray(F.col("v"), F.col("v") * 3 % 256, F.col("v") * 7 % 256).cast("long").alias("gray")), cte("pixels") + "select image_id, x, y, (v * 114 + v * 3 % 256 * 587 + v * 7 % 256 * 299 + 500) // 1000 as gray from pixels")
    add("roi_scale_clip", lambda s, d: pixels.scale_points(fx.points(s, d).select("image_id", "pid", "x", "y", F.lit(300).alias("width"), F.lit(200).alias("height")), 400, 400).select("image_id", "pid", r6("sx").alias("sx"), r6("sy").alias("sy")), cte("points") + "select image_id, pid, round(least(greatest(x * 300 / 400.0, 0), 299), 6) as sx, round(least(greatest(y * 200 / 400.0, 0), 199), 6) as sy from points")
    # the region's edges: inside is right of none of them, since the region is convex
    half = " and ".join(f"({x2 - x1}) * (y - {y1}) - ({y2 - y1}) * (x - {x1}) >= 0" for (x1, y1), (x2, y2) in zip(ROI, ROI[1:] + ROI[:1], strict=True))
    add("roi_polygon_crop", lambda s, d: pixels.crop(px(s, d), ROI), cte("pixels") + f"select image_id, x - 3 as x, y - 2 as y, case when {half} then v else 255 end as v from pixels where x between 3 and 61 and y between 2 and 60")
    add("area_downscale", lambda s, d: pixels.area_downscale(px(s, d), 4, 5), cte("pixels") + "select image_id, x // 4 as x, y // 4 as y, floor(sum(v) / 16.0 + 0.5)::bigint as v, floor(sum(v) / 16.0 + 0.5) <= 5 as dark from pixels group by 1, 2, 3")
    add("nearest_upscale", lambda s, d: pixels.nearest_upscale(px(s, d), 2), cte("pixels") + "select image_id, x * 2 + a.i as x, y * 2 + b.j as y, v from pixels, (values (0), (1)) a(i), (values (0), (1)) b(j)")
    for name, f, k in (("dilate", pixels.dilate, 5), ("erode", pixels.erode, 2)):
        sql = dilate_sql("mask", k) if name == "dilate" else erode_sql("mask", k)
        add(name, lambda s, d, f=f, k=k: f(mask(s, d), N, N, k), cte("pixels", mask=MASK) + sql)
    add("morphological_open", lambda s, d: pixels.open_(mask(s, d, 10), N, N, 3, "cross"), cte("pixels", mask="select image_id, x, y from pixels where v > 10", small=erode_sql("mask", 3, "cross")) + dilate_sql("small", 3, "cross"))
    add("morphological_close", lambda s, d: pixels.close_(mask(s, d), N, N, 3), cte("pixels", mask=MASK, big=dilate_sql("mask", 3)) + erode_sql("big", 3))
    add("band_mask", lambda s, d: pixels.band_mask(mask(s, d, 45), px(s, d).select("image_id").distinct().withColumn("spacing", F.lit(20.0)), N, N), cte("pixels", mask="select image_id, x, y from pixels where v > 45") + f"select image_id, x, y, 0 as v from ({dilate_sql('mask', 5)})")
    weight = "(values " + ", ".join(f"({k - 2}, {w!r}::double)" for k, w in enumerate(blur)) + ")"
    grid = f"select s_suppkey as image_id, c % {N} as x, c // {N} as y, coalesce(v, 0) as v from supplier, range({N * N}) r(c) left join pixels p on p.image_id = s_suppkey and p.x = c % {N} and p.y = c // {N}"
    add(
        "gauss_adaptive_threshold",
        lambda s, d: pixels.gauss_threshold(fx.dense(s, d), blur, 7),
        cte("pixels", grid=grid, across=f"select g.image_id, g.x, g.y, g.v, sum(h.v * a.w) as s from grid g, {weight} a(i, w), grid h where h.image_id = g.image_id and h.x = least(greatest(g.x + a.i, 0), {N - 1}) and h.y = g.y group by all", mean=f"select g.image_id, g.x, g.y, g.v, round_even(round(sum(h.s * b.w), 9), 0)::bigint as mean from across g, {weight} b(j, w), across h where h.image_id = g.image_id and h.x = g.x and h.y = least(greatest(g.y + b.j, 0), {N - 1}) group by all") + "select image_id, x, y, v, mean, v - mean <= -7 as hole from mean",
    )
    add("pixel_components", labels, regions() + "select image_id, x, y, label from labels")
    add("component_stats", lambda s, d: pixels.region_stats(labels(s, d)).withColumns({"cx": r6("cx"), "cy": r6("cy")}), regions() + 'select image_id, label, "left", "top", width, height, area, round(cx, 6) as cx, round(cy, 6) as cy from stats')
    add("component_features", lambda s, d: features(s, d).select("image_id", "label", r6("aspect").alias("aspect"), r6("fill").alias("fill")), regions() + "select image_id, label, round(aspect, 6) as aspect, round(fill, 6) as fill from features")
    add("component_filter", lambda s, d: kept(s, d).select("image_id", "label", "area"), regions() + "select image_id, label, area from kept")
    add("border_drop", lambda s, d: pixels.drop_border(labels(s, d), N, N), regions() + f"select image_id, x, y, label from labels where (image_id, label) not in (select (image_id, label) from labels where x = 0 or y = 0 or x = {N - 1} or y = {N - 1})")
    add("mask_backproject", lambda s, d: pixels.back_project(labels(s, d), kept(s, d)), regions() + "select image_id, x, y, label from labels where (image_id, label) in (select (image_id, label) from kept)")
    add("hole_centroids", lambda s, d: kept(s, d).select("image_id", "label", r6("cx").alias("cx"), r6("cy").alias("cy")), regions() + "select image_id, label, round(cx, 6) as cx, round(cy, 6) as cy from kept")
    add("standalone_centres", lambda s, d: pixels.standalone_centres(features(s, d), N, N).withColumns({"cx": r6("cx"), "cy": r6("cy")}), regions() + f'select image_id, label, round(cx, 6) as cx, round(cy, 6) as cy, count(*) over (partition by image_id) as centres from features where area between 2 and 200 and aspect <= 3 and fill >= 0.2 and "left" > 0 and "top" > 0 and "left" + width < {N} and "top" + height < {N}')
    near = [(dx, dy) for dx in range(-3, 4) for dy in range(-3, 4) if 0 < dx * dx + dy * dy <= 9]
    free = f"select m.image_id, m.x, m.y, min(s.dx * s.dx + s.dy * s.dy) as d2 from mask m, (values {', '.join(map(str, near))}) s(dx, dy) where m.x + s.dx between 0 and {N - 1} and m.y + s.dy between 0 and {N - 1} and not exists (select 1 from mask o where o.image_id = m.image_id and o.x = m.x + s.dx and o.y = m.y + s.dy) group by 1, 2, 3"
    dist = "select m.image_id, m.x, m.y, sqrt(f.d2) as d from mask m left join free f on f.image_id = m.image_id and f.x = m.x and f.y = m.y"
    add("distance_exact", lambda s, d: pixels.exact_distance(mask(s, d, 10), N, N, 3).withColumn("d", r6("d")), cte("pixels", mask="select image_id, x, y from pixels where v > 10", free=free) + dist.replace("sqrt(f.d2)", "round(sqrt(f.d2), 6)"))
    add("skeleton_candidates", lambda s, d: pixels.skeleton_candidates(mask(s, d, 30), pixels.exact_distance(mask(s, d, 10), N, N, 3), 1.2, 3.0).withColumn("d", r6("d")), cte("pixels", mask="select image_id, x, y from pixels where v > 10", free=free, dist=dist) + "select p.image_id, p.x, p.y, round(d.d, 6) as d from pixels p join dist d on d.image_id = p.image_id and d.x = p.x and d.y = p.y where p.v > 30 and d.d between 1.2 and 3.0")
    probe = ", ".join(f"({k}, {c!r}::double, {s!r}::double)" for k, c, s in sees)
    to = lambda a, f, sg: f"least(greatest(m.{a} + {sg} * round_even(5.0 * t.{f}, 0)::bigint, 0), {N - 1})"
    look = " and ".join(f"not exists (select 1 from pixels p where p.v > 25 and p.image_id = m.image_id and p.x = {to('x', 'c', sg)} and p.y = {to('y', 's', sg)})" for sg in ("1", "-1"))
    add("two_sided_probe", lambda s, d: pixels.two_sided_probe(mask(s, d, 40).withColumn("d", F.lit(1.0)), mask(s, d), N, N, angles=4), cte("pixels") + f"select distinct m.image_id, m.x, m.y from pixels m, (values {probe}) t(k, c, s) where m.v > 40 and {look}")
    add("reconnect", lambda s, d: pixels.reconnect(mask(s, d), mask(s, d, 48), N, N, 5), cte("pixels", seeds="select image_id, x, y from pixels where v > 48", near=dilate_sql("seeds", 5)) + "select image_id, x, y from pixels where v > 25 and (image_id, x, y) in (select (image_id, x, y) from near)")
    sizes = lambda s, d: fx.load(s, d, "supplier").select(F.col("s_suppkey").alias("image_id"), F.lit(N).cast("long").alias("width"), F.lit(N).cast("long").alias("height"))
    box = "select image_id, min({c}) as a, max({c}) as b from (select image_id, {c} from pixels where v > 20 group by 1, 2 having count(*) >= 6) group by 1"
    edges = "least(greatest(c.a + 3, 0), 63) as l, least(greatest(r.a + 3, 0), 63) as t, least(greatest(c.b - 3, 0), 63) as rt, least(greatest(r.b - 3, 0), 63) as b"
    add("inner_rect", lambda s, d: pixels.inner_rect(mask(s, d, 20), sizes(s, d), share=0.1, inset=3), cte("pixels", cols=box.format(c="x"), rows_=box.format(c="y"), e=f"select s_suppkey as image_id, {edges} from supplier left join cols c on c.image_id = s_suppkey left join rows_ r on r.image_id = s_suppkey") + 'select image_id, case when l < rt and t < b then l else 0 end as "left", case when l < rt and t < b then t else 0 end as "top", case when l < rt and t < b then rt else 63 end as "right", case when l < rt and t < b then b else 63 end as "bottom" from e')
    small = lambda s, d: fx.points(s, d).select((F.col("pid") % 100 + 1).alias("image_id"), F.col("pid").alias("seg_id"), F.floor(F.col("x") / 7).alias("x0"), F.floor(F.col("y") / 7).alias("y0"), F.floor(F.col("y") / 8 + 5).alias("x1"), F.floor(F.col("x") / 8 + 2).alias("y1"))
    tiny = "select pid % 100 + 1 as image_id, pid as seg_id, floor(x / 7)::bigint as x0, floor(y / 7)::bigint as y0, floor(y / 8 + 5)::bigint as x1, floor(x / 8 + 2)::bigint as y1 from points"
    sampled = "select g.*, greatest(2, ceil(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / 6.0)::bigint) as n, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) as size from tiny g"
    spots = "select image_id, seg_id, size, least(greatest(round_even(x0 + (x1 - x0) * (i / (n - 1)), 0), 0), 63)::bigint as x, least(greatest(round_even(y0 + (y1 - y0) * (i / (n - 1)), 0), 0), 63)::bigint as y from sampled, unnest(range(n)) u(i)"
    add("black_ratio", lambda s, d: pixels.black_ratio(small(s, d), mask(s, d, 10), N, N).withColumn("black_ratio", r6("black_ratio")), cte("points", "pixels", tiny=tiny, sampled=sampled, spots=spots) + "select s.image_id, s.seg_id, round(case when max(size) < 1e-6 then 0.0 else count(p.v) / count(*) end, 6) as black_ratio from spots s left join pixels p on p.image_id = s.image_id and p.x = s.x and p.y = s.y and p.v > 10 group by 1, 2")

    # points
    add("nn_distance", lambda s, d: points.nearest_neighbours(fx.points(s, d)).withColumn("d", r6("d")), cte("points", neighbours=NEIGHBOURS) + "select image_id, pid, round(d, 6) as d from neighbours")
    add("spacing", lambda s, d: graph(s, d)[1].withColumn("spacing", r6("spacing")), cte("points", neighbours=NEIGHBOURS) + "select image_id, round(median(d), 6) as spacing from neighbours group by 1")
    add("annulus_edges", lambda s, d: graph(s, d)[2].withColumn("d", r6("d")), cte("points", **GROUPS) + "select image_id, u, v, round(d, 6) as d from edges")
    add("point_components", lambda s, d: points.point_components(graph(s, d)[2]), cte("points", **GROUPS) + "select image_id, comp_id, pid from members")
    add("component_size_filter", lambda s, d: points.component_sizes(points.point_components(graph(s, d)[2])), cte("points", **GROUPS) + "select image_id, comp_id, count(*) as n_points from members group by 1, 2 having count(*) >= 4")
    area = cte("points", **GROUPS, corners=CORNERS, sides=SIDES, hulls=HULLS, big="select h.* from hulls h join spacings s on s.image_id = h.image_id where h.area >= greatest(12.0, s.spacing * s.spacing * 0.20)")
    add("hull_area", lambda s, d: points.polygon_area(hulls(s, d)).select("image_id", "comp_id", r6("shoelace").alias("area")), area + "select image_id, comp_id, area from big")
    # rounded twice, and by a product, as DuckDB does: the first rounding makes ties, which fall by that product
    add("hull_perimeter", lambda s, d: points.polygon_perimeter(hulls(s, d)).select("image_id", "comp_id", (F.round(r6("around") * 1e4) / 1e4).alias("perimeter")), area + "select image_id, comp_id, round(perimeter, 4) as perimeter from big")
    add("hull_simplify", lambda s, d: hulls(s, d).select("image_id", "comp_id", F.size("hull").alias("n_hull"), F.size("simplified").alias("n_simplified")), None)
    add("region_masks", lambda s, d: points.region_masks(fx.points(s, d), fx.points(s, d), 2400, 400, "instances").select("image_id", "centres", F.sha2("mask", 256).alias("mask_sha256")), None)

    # lines
    votes = ", ".join(f"({k}, {c!r}::double, {s!r}::double)" for k, c, s in turns)
    add("hough_votes", lambda s, d: lines.hough_votes(mask(s, d), 4, 15).select("image_id", F.col("theta").cast("long").alias("theta"), "rho", "votes"), cte("pixels", mask=MASK) + f"select image_id, a.k::bigint as theta, floor(round(x * a.c + y * a.s, 9) + 0.5)::bigint as rho, count(*) as votes from mask, (values {votes}) a(k, c, s) group by 1, 2, 3 having count(*) >= 4")
    long = "select *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) as length, atan2(y2 - y1, x2 - x1) as raw from hough where sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) >= 200"
    add("segment_features", lambda s, d: lines.segment_features(fx.hough(s, d), 200).select("image_id", "seg_no", r6("length").alias("length"), r6("angle").alias("angle")), cte("hough", long_ones=long) + "select image_id, seg_no, round(length, 6) as length, round(case when raw < 0 then raw + pi() else raw end, 6) as angle from long_ones qualify count(*) over (partition by image_id) >= 2")
    add("direction_families", lambda s, d: (lambda f: lines.cluster_segments(f, 55).select("image_id", "seg_no", "family", "cluster"))(lines.segment_features(fx.hough(s, d), 200)), None)
    add("tls_line_fit", lambda s, d: fitted(s, d).select("image_id", "family", r4("ox").alias("ox"), r4("oy").alias("oy"), r4("dx").alias("dx"), r4("dy").alias("dy")), cte("hough", ends=ENDS, fit=FIT, signed="select *, case when cos(a) * case fam when 0 then 0.5 else -0.8 end + sin(a) * case fam when 0 then 0.87 else 0.6 end < 0 then -1 else 1 end as sg from fit") + "select image_id, fam as family, round(ox, 4) as ox, round(oy, 4) as oy, round(cos(a) * sg, 4) as dx, round(sin(a) * sg, 4) as dy from signed")
    add("line_support", lambda s, d: fitted(s, d).select("image_id", "family", "support_count", F.round("support_length", 1).alias("support_length")), cte("hough", ends=ENDS, fit=FIT) + "select image_id, fam as family, support_count, round(round_even(support, 2), 1) as support_length from fit")
    add("line_crossings", lambda s, d: line_graph(s, d)[1].select("image_id", "node_id", "line_a", "line_b", r6("x").alias("x"), r6("y").alias("y")), cte("lines", crossed=GRAPH["crossed"]) + "select image_id, node_id, line_a, line_b, round(x, 6) as x, round(y, 6) as y from crossed")
    add("rect_intersections", lambda s, d: lines.rect_hits(fx.lines(s, d), fx.rects(s, d)).select("image_id", "line_id", "ord", r6("x").alias("x"), r6("y").alias("y")), cte("lines", raw_hits=GRAPH["raw_hits"], hits=GRAPH["hits"]) + "select image_id, line_id, ord, round(x, 6) as x, round(y, 6) as y from hits")
    add("boundary_nodes", lambda s, d: line_graph(s, d)[2].filter("kind = 'boundary'").select("image_id", "line_id", "node_id", r6("x").alias("x"), r6("y").alias("y")), cte("lines", **GRAPH) + "select image_id, line_id, 'B' || n as node_id, round(x, 6) as x, round(y, 6) as y from bound")
    add("line_segments", lambda s, d: lines.line_segments(line_graph(s, d)[2]).select("image_id", "seg_id", "line_index", "from_node", "to_node", "length"), cte("lines", **GRAPH) + "select image_id, 'S' || (row_number() over (partition by image_id order by line_id, pos) - 1) as seg_id, line_id as line_index, node_id as from_node, to_id as to_node, round_even(size, 2) as length from once")
    dark = cte("pixels", "small_lines", **SMALL)
    add("boundary_nodes_black", lambda s, d: dark_graph(s, d)[0].filter("kind = 'boundary'").select("image_id", "line_id", "node_id", r6("x").alias("x"), r6("y").alias("y")), dark + "select image_id, line_id, 'B' || n as node_id, round(x, 6) as x, round(y, 6) as y from bound")
    add("line_segments_black", lambda s, d: dark_graph(s, d)[1].select("image_id", "seg_id", "line_index", "from_node", "to_node", "length"), dark + "select image_id, 'S' || (row_number() over (partition by image_id order by line_id, pos) - 1) as seg_id, line_id as line_index, node_id as from_node, to_id as to_node, round_even(size, 2) as length from once")
    add("geo_document_counts", geo_counts, cte("lines", **GRAPH) + "select l.image_id, l.c as line_count, n.c as node_count, coalesce(s.c, 0) as segment_count from (select image_id, count(*) as c from lines group by 1) l join (select image_id, count(distinct node_id) as c from all_nodes group by 1) n on n.image_id = l.image_id left join (select image_id, count(*) as c from once group by 1) s on s.image_id = l.image_id")

    # comparison
    geo_nodes = cte("nodes", "segments", degrees=DEGREES, moves=MOVES, costs=COSTS)
    add("node_degree", lambda s, d: compare.node_degrees(fx.nodes(s, d), fx.segments(s, d)).select("image_id", "node_id", "degree"), geo_nodes + "select image_id, node_id, degree from degrees")
    add("kind_translation", lambda s, d: compare.translations(fx.nodes(s, d), 1).select("image_id", "kind", r6("tx").alias("tx"), r6("ty").alias("ty")), geo_nodes + "select image_id, kind, round(tx, 6) as tx, round(ty, 6) as ty from moves")
    add("node_cost", lambda s, d: compare.node_costs(compare.node_degrees(fx.nodes(s, d), fx.segments(s, d)), compare.translations(fx.nodes(s, d), 1), 1).withColumn("cost", r4("cost")), geo_nodes + "select image_id, kind, ref_node, tgt_node, round(cost, 4) as cost from costs")
    add("node_assignment", lambda s, d: assigned(s, d).groupBy("image_id", "kind").agg(F.count(F.lit(1)).alias("n_pairs"), r4(F.sum("cost")).alias("total")), cte("nodes", "segments", degrees=DEGREES, moves=MOVES, costs=COSTS, ranked=RANKED, numbered=NUMBERED, **subsets_sql()) + "select image_id, kind, n_pairs, round(total, 4) as total from cheapest")
    geo = cte("nodes", "segments", geometry=GEOMETRY, matched=MATCHED, moved=MOVED)
    add("segment_match", lambda s, d: moved(s, d).select("image_id", "ref_segment", "target_segment"), geo + "select image_id, ref_segment, target_segment from matched")
    add("segment_transform", lambda s, d: moved(s, d).select("image_id", "ref_segment", "target_segment", r4("rotation_deg").alias("rotation_deg"), r4("translation_midpoint_xy.x").alias("mid_x"), r4("translation_midpoint_xy.y").alias("mid_y"), r4("rigid_translation_xy.x").alias("rigid_x"), r4("rigid_translation_xy.y").alias("rigid_y"), r4("length_ratio").alias("length_ratio")), geo + "select * from moved")
    add("comparison_summary", lambda s, d: compare.comparison_documents(*graphs(s, d), 1).drop("node_mapping", "segment_matches"), None)
    add("console_report", lambda s, d: report(moved(s, d)), None)
    add("draw_list", lambda s, d: draw.result_shapes(fx.segments(s, d), fx.nodes(s, d)), cte("nodes", "segments") + "select image_id, 1 as z, 'line' as shape, x0, y0, x1, y1, 255 as color from segments union all select image_id, 2, 'dot', round_even(x, 0)::bigint, round_even(y, 0)::bigint, round_even(x, 0)::bigint, round_even(y, 0)::bigint, case kind when 'crossing' then 65280 else 16776960 end from nodes")

    # series
    add("box_smooth", lambda s, d: series.box_smooth(fx.series(s, d), 5).withColumn("smooth", r6("smooth")), cte("series") + "select series_id, pos, round(sum(value) over (partition by series_id order by pos rows between 2 preceding and 2 following) / 5, 6) as smooth from series")
    add("longest_span", lambda s, d: series.longest_span(fx.series(s, d)), cte("series", ranked="select *, row_number() over (partition by series_id order by pos) - 1 as n from series", runs="select series_id, n, n - row_number() over (partition by series_id order by pos) as run from ranked where active", spans="select series_id, run, min(n) as first, max(n) as last from runs group by 1, 2") + "select series_id, first, last from spans qualify row_number() over (partition by series_id order by last - first desc, first) = 1")
    return out


def geo_counts(spark: SparkSession, d: str) -> DataFrame:
    ln, _, nodes = line_graph(spark, d)
    images = fx.rects(spark, d).withColumns({"source": F.lit("derived"), "width": F.lit(1631), "height": F.lit(2245)})
    full = ln.withColumns({"support_count": F.lit(1).cast("long"), "support_length": F.lit(0.0)})
    docs = lines.geo_documents(images, full, nodes, lines.line_segments(nodes))
    return docs.select("image_id", *[F.col(c).cast("long").alias(c) for c in ("line_count", "node_count", "segment_count")])


def report(matches: DataFrame) -> DataFrame:
    t = F.col("translation_midpoint_xy")
    return matches.select("image_id", report_line(F.col("ref_segment"), F.col("target_segment"), F.col("rotation_deg"), t["x"], t["y"], F.col("length_ratio")).alias("line"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in registry().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in registry().items() if sql}
