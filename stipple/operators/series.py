"""Two operators over one-dimensional series (series_id, pos, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def box_smooth(series: DataFrame, window: int) -> DataFrame:
    """A centred box filter: absent neighbours count as 0, and the full window divides."""
    before, after = window // 2, (window - 1) // 2
    w = Window.partitionBy("series_id").orderBy("pos").rowsBetween(-before, after)
    return series.select("series_id", "pos", (F.sum("value").over(w) / window).alias("smooth"))


def longest_span(series: DataFrame, active: str = "active") -> DataFrame:
    """The longest run of active positions of each series, the first of equal ones; (0, -1) if none is active."""
    w = Window.partitionBy("series_id").orderBy("pos")
    n = F.row_number().over(w)
    runs = series.withColumn("n", n - 1).filter(F.col(active)).withColumn("run", F.col("n") - F.row_number().over(w))
    spans = runs.groupBy("series_id", "run").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    best = spans.groupBy("series_id").agg(F.min_by(F.struct("first", "last"), F.struct((F.col("first") - F.col("last")).alias("neg"), "first")).alias("b"))
    every = series.select("series_id").distinct()
    return every.join(best, "series_id", "left").select("series_id", F.coalesce("b.first", F.lit(0)).cast("long").alias("first"), F.coalesce("b.last", F.lit(-1)).cast("long").alias("last"))
