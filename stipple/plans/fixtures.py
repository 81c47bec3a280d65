"""Geometric relations derived from the driver's tables, by arithmetic that is exact in Spark and in DuckDB.

Each has a DataFrame form and the same relation as SQL, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 64  # width and height of the derived images

SQL = {
    "points": """select p_partkey // 400 as image_id, p_partkey as pid, ((p_partkey % 400) % 20) * 20.0::double + p_size % 5 + (p_size % 5 // 2) * 1000 as x,
        ((p_partkey % 400) // 20) * 20.0::double + p_size % 3 as y from part""",
    "pixels": """select l_suppkey as image_id, l_partkey % 64 as x, l_orderkey % 64 as y, max(l_quantity)::bigint as v from lineitem group by 1, 2, 3""",
    "lines": """select s_suppkey // 10 as image_id, s_suppkey % 10 as line_id, s_suppkey % 2 as family,
        200.0::double + (s_suppkey * 37 % 11) * 100 as ox, 300.0::double + (s_suppkey * 53 % 13) * 100 as oy,
        case when s_suppkey % 2 = 0 then 0.6 else -0.8 end::double as dx, case when s_suppkey % 2 = 0 then 0.8 else 0.6 end::double as dy,
        -700.0::double as tmin, 700.0::double as tmax from supplier""",
    "small_lines": """select s_suppkey // 10 as image_id, s_suppkey % 10 as line_id, s_suppkey % 2 as family,
        4.0::double + (s_suppkey * 37 % 11) * 5 as ox, 6.0::double + (s_suppkey * 53 % 13) * 4 as oy,
        case when s_suppkey % 2 = 0 then 0.6 else -0.8 end::double as dx, case when s_suppkey % 2 = 0 then 0.8 else 0.6 end::double as dy,
        -40.0::double as tmin, 40.0::double as tmax from supplier""",
    "hough": """select o_custkey % 50 as image_id, o_orderkey as seg_no, o_orderkey * 7 % 1600 as x1, o_orderkey * 13 % 2200 as y1,
        o_orderkey * 7 % 1600 + case when o_orderkey % 2 = 0 then 110 + o_orderkey % 37 else -(170 + o_orderkey % 41) end as x2,
        o_orderkey * 13 % 2200 + case when o_orderkey % 2 = 0 then 190 + o_orderkey % 43 else 130 + o_orderkey % 31 end as y2 from orders""",
    "nodes": """select c_custkey // 12 as image_id, case when c_custkey % 12 < 4 then 'C' else 'B' end || (c_custkey % 12) as node_id,
        case when c_custkey % 12 < 4 then 'crossing' else 'boundary' end as kind, ((c_custkey % 12) % 4) * 300.0::double + c_custkey * 37 % 41 as x,
        ((c_custkey % 12) // 4) * 400.0::double + c_custkey * 53 % 43 as y, c_custkey % 12 as k from customer""",
    "segments": """select a.image_id, 'S' || (a.k * 2 + s.d) as seg_id, case when (a.image_id + a.k) % 5 = 0 then b.node_id else a.node_id end as from_node,
        case when (a.image_id + a.k) % 5 = 0 then a.node_id else b.node_id end as to_node,
        case when (a.image_id + a.k) % 5 = 0 then b.x else a.x end::bigint as x0, case when (a.image_id + a.k) % 5 = 0 then b.y else a.y end::bigint as y0,
        case when (a.image_id + a.k) % 5 = 0 then a.x else b.x end::bigint as x1, case when (a.image_id + a.k) % 5 = 0 then a.y else b.y end::bigint as y1
        from nodes a join (values (0, 1), (1, 4)) s(d, w) on true join nodes b on a.image_id = b.image_id and b.k = a.k + s.w and (s.w = 4 or a.k % 4 < 3)
        where (a.image_id * 7 + a.k) % 11 <> 3""",
    "series": """select event_type as series_id, event_id as pos, value, value > 50 as active from events""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    """All parts: three patterns beside each other in each image, by size, with holes missing in each."""
    p = F.col("p_partkey")
    k = p % 400
    part = F.col("p_size") % 5
    return load(spark, d, "part").select(F.floor(p / 400).alias("image_id"), p.alias("pid"), ((k % 20) * 20.0 + part + F.floor(part / 2) * 1000).alias("x"), (F.floor(k / 20) * 20.0 + F.col("p_size") % 3).alias("y"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_orderkey") % 64).alias("y"), "l_quantity")
    return rows.groupBy("image_id", "x", "y").agg(F.max("l_quantity").cast("long").alias("v"))


def mask(spark: SparkSession, d: str, above: int = 25) -> DataFrame:
    return pixels(spark, d).filter(F.col("v") > above).select("image_id", "x", "y")


def dense(spark: SparkSession, d: str) -> DataFrame:
    """All cells of the pictures, one picture for each supplier."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(SIZE * SIZE - 1)))
    grid = load(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), cells.alias("c")).select("image_id", (F.col("c") % SIZE).cast("long").alias("x"), F.floor(F.col("c") / SIZE).alias("y"))
    return grid.join(pixels(spark, d), ["image_id", "x", "y"], "left").select("image_id", "x", "y", F.coalesce("v", F.lit(0)).alias("v"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    even = s % 2 == 0
    return load(spark, d, "supplier").select(F.floor(s / 10).alias("image_id"), (s % 10).alias("line_id"), (s % 2).alias("family"), (200.0 + (s * 37 % 11) * 100).alias("ox"), (300.0 + (s * 53 % 13) * 100).alias("oy"), F.when(even, 0.6).otherwise(-0.8).alias("dx"), F.when(even, 0.8).otherwise(0.6).alias("dy"), F.lit(-700.0).alias("tmin"), F.lit(700.0).alias("tmax"))


def small_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines across the pictures of SIZE x SIZE pixels."""
    own = lines(spark, d).withColumn("s", F.col("image_id") * 10 + F.col("line_id"))
    s = F.col("s")
    return own.select("image_id", "line_id", "family", (4.0 + (s * 37 % 11) * 5).alias("ox"), (6.0 + (s * 53 % 13) * 4).alias("oy"), "dx", "dy", F.lit(-40.0).alias("tmin"), F.lit(40.0).alias("tmax"))


def rects(spark: SparkSession, d: str, box: tuple[int, int, int, int] = (50, 74, 1580, 2190)) -> DataFrame:
    own = load(spark, d, "supplier").select(F.floor(F.col("s_suppkey") / 10).alias("image_id")).distinct()
    return own.select("image_id", *[F.lit(v).alias(c) for c, v in zip(("left", "top", "right", "bottom"), box, strict=True)])


def hough(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    even = k % 2 == 0
    x, y = k * 7 % 1600, k * 13 % 2200
    return load(spark, d, "orders").select((F.col("o_custkey") % 50).alias("image_id"), k.alias("seg_no"), x.alias("x1"), y.alias("y1"), (x + F.when(even, k % 37 + 110).otherwise(-(k % 41 + 170))).alias("x2"), (y + F.when(even, k % 43 + 190).otherwise(k % 31 + 130)).alias("y2"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    k = c % 12
    return load(spark, d, "customer").select(F.floor(c / 12).alias("image_id"), F.concat(F.when(k < 4, "C").otherwise("B"), k.cast("string")).alias("node_id"), F.when(k < 4, "crossing").otherwise("boundary").alias("kind"), ((k % 4) * 300.0 + c * 37 % 41).alias("x"), (F.floor(k / 4) * 400.0 + c * 53 % 43).alias("y"), k.alias("k"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    a = n.select("image_id", F.col("k"), F.struct("node_id", "x", "y").alias("a"), F.explode(F.array(F.struct(F.lit(0).alias("d"), F.lit(1).alias("w")), F.struct(F.lit(1).alias("d"), F.lit(4).alias("w")))).alias("s"))
    a = a.filter("(s.w = 4 or k % 4 < 3) and (image_id * 7 + k) % 11 <> 3").withColumn("j", F.col("k") + F.col("s.w"))
    b = n.select("image_id", F.col("k").alias("j"), F.struct("node_id", "x", "y").alias("b"))
    swap = (F.col("image_id") + F.col("k")) % 5 == 0
    one, two = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    both = a.join(b, ["image_id", "j"]).select("image_id", F.concat(F.lit("S"), (F.col("k") * 2 + F.col("s.d")).cast("string")).alias("seg_id"), one.alias("p"), two.alias("q"))
    return both.select("image_id", "seg_id", F.col("p.node_id").alias("from_node"), F.col("q.node_id").alias("to_node"), *[F.col(f"{e}.{c}").cast("long").alias(f"{c}{i}") for i, e in enumerate("pq") for c in "xy"])


def series(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.col("event_type").alias("series_id"), F.col("event_id").alias("pos"), "value", (F.col("value") > 50).alias("active"))
