"""Approximate nearest neighbours: stable projections, a kd-tree over them, and a chi-square stopping test."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stipple.llm.common import cut, prepare, table

#: Dimensions of the projection (even, for the closed form of the chi-square distribution).
PROJECTED = 8
#: The chance, for each true neighbour, that the search goes on until its projection was seen.
CONFIDENCE = 0.97
#: Distinct vectors in a shard, and queries in a block, at most or on average.
SHARD_ROWS, BLOCK_QUERIES = 8192, 2048
#: Projections, drawn by a hash of the vector, from which the driver fits the cells of the space (64 bytes each), and
#: how many a cell has at least.  All vectors are indexed, whether drawn or not.
SAMPLE, CELL_SAMPLE = 1 << 20, 32
_LEAF, _STEP = 32, 6


def chi_square_quantile(p: float, m: int) -> float:
    """For an even number m of degrees of freedom, by bisection of the closed form."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    low, high = 0.0, 64.0 * m
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


class Tree:
    """A kd-tree over projected vectors: splits at the median of the widest dimension down to small leaves."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self._build(np.arange(len(points)))
        self.lows, self.highs = np.array(self.low), np.array(self.high)

    def _build(self, rows: np.ndarray) -> int:
        own = self.points[rows]
        k = len(self.rows)
        self.low.append(own.min(0)), self.high.append(own.max(0)), self.rows.append(None), self.children.append(None)
        if len(rows) <= _LEAF:
            self.rows[k] = rows
        else:
            axis = int(np.argmax(self.high[k] - self.low[k]))
            order = np.argpartition(own[:, axis], len(rows) // 2)
            half = len(rows) // 2
            self.children[k] = (self._build(rows[order[:half]]), self._build(rows[order[half:]]))
        return k

    def nearest_first(self, q: np.ndarray):
        """Leaves' rows by their least possible projected distance, which comes with them, squared."""
        gap = np.maximum(np.maximum(self.lows - q, q - self.highs), 0)
        bound = (gap * gap).sum(1)
        heap = [(bound[0], 0)]
        while heap:
            d, k = heapq.heappop(heap)
            if self.children[k] is None:
                yield d, self.rows[k]
            else:
                for c in self.children[k]:
                    heapq.heappush(heap, (bound[c], c))


class Cells:
    """Boxes that part the projected space: halves by the median of the widest dimension of a sample, again and again."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axis: list[int] = []
        self.at: list[float] = []
        self.children: list[tuple[int, int]] = []  # of a node; cells are told as -1 - number
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        inf = np.full(PROJECTED, np.inf)
        self.top = self._part(sample, cells, -inf, inf)
        self.lows, self.highs = np.array(self.low), np.array(self.high)

    def _part(self, own: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        axis = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
        at = float(np.median(own[:, axis])) if len(own) else 0.0
        left = own[:, axis] < at
        if cells < 2 or len(own) < 2 * CELL_SAMPLE or left.all() or not left.any():
            self.low.append(low), self.high.append(high)
            return -len(self.low)
        k = len(self.axis)
        self.axis.append(axis), self.at.append(at), self.children.append((0, 0))
        edge = low.copy(), high.copy()
        edge[0][axis] = edge[1][axis] = at
        self.children[k] = (self._part(own[left], cells // 2, low, edge[1]), self._part(own[~left], cells - cells // 2, edge[0], high))
        return k

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of every point."""
        node = np.full(len(points), self.top)
        axis, at, children = np.array(self.axis, np.int64), np.array(self.at), np.array(self.children, np.int64).reshape(-1, 2)
        while (inner := np.flatnonzero(node >= 0)).size:
            k = node[inner]
            node[inner] = children[k, (points[inner, axis[k]] >= at[k]).astype(np.int64)]
        return -1 - node

    def within(self, point: np.ndarray, squared: float) -> np.ndarray:
        """Cells that come nearer to a point than a squared distance, nearest first."""
        gap = np.maximum(np.maximum(self.lows - point, point - self.highs), 0)
        bound = (gap * gap).sum(1)
        near = np.flatnonzero(bound <= squared)
        return near[np.argsort(bound[near], kind="stable")]


def projection(dims: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((dims, PROJECTED))


def search_shard(ids: list[np.ndarray], points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, worst: np.ndarray, k: int, confidence: float = CONFIDENCE) -> tuple[list, list, list]:
    """The k nearest found in one shard for each query, no farther than `worst`: query ids, vector ids, distances.

    ids: the least ids of each distinct point, which are all that an answer can hold.
    """
    matrix = projection(points.shape[1])
    tree = Tree(points @ matrix)
    limit = chi_square_quantile(confidence, PROJECTED)
    out: tuple[list, list, list] = ([], [], [])
    for qid, q, most in zip(query_ids, queries, worst, strict=True):
        best: list[tuple[float, int]] = []  # distance, id
        todo: list[np.ndarray] = []
        for d, rows in tree.nearest_first(q @ matrix):
            if len(todo) >= _STEP:
                best = _verify(np.concatenate(todo), points, q, qid, ids, best, k)
                most = min(most, best[k - 1][0]) if len(best) >= k else most
                todo = []
            if d > limit * most * most:  # the next projected neighbour is so far that a nearer vector is unlikely
                break
            todo.append(rows)
        if todo:
            best = _verify(np.concatenate(todo), points, q, qid, ids, best, k)
        out[0].extend([int(qid)] * len(best)), out[1].extend(i for _, i in best), out[2].extend(d for d, _ in best)
    return out


def _verify(rows: np.ndarray, points: np.ndarray, q: np.ndarray, qid: int, ids: list[np.ndarray], best: list[tuple[float, int]], k: int) -> list[tuple[float, int]]:
    gap = points[rows] - q
    d = np.sqrt((gap * gap).sum(1))
    if len(best) >= k:
        near = d <= best[k - 1][0]
        rows, d = rows[near], d[near]
    elif len(d) > k + 1:  # more distinct points than k can't all be among the k nearest
        near = d <= np.partition(d, k)[k]
        rows, d = rows[near], d[near]
    best = best + [(x, int(i)) for r, x in zip(rows.tolist(), d.tolist(), strict=True) for i in ids[r] if i != qid]
    best.sort()
    return best[:k]


def _vectors(b: pa.RecordBatch, dims: int) -> np.ndarray:
    return b.column("v").flatten().to_numpy().reshape(-1, dims)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest vectors found for each query, by Euclidean distance in double precision.

    Returns ``query_id`` long, ``rank`` int from 1, ``vec_id`` long and ``score`` double, the distance between the
    original vectors; ties go to the smaller id.  Both tables have an id and an array column, others are ignored.  A
    query's own row is no candidate.  Rows whose id is null, and vectors that are null, empty, zero, or hold a null
    or a non-finite component, take no part; neither do vectors of another length than most.  Of queries with one id
    the one with the least vector counts; repeated candidates are so many.  Fewer than k candidates give fewer rows; an
    empty table gives none.

    1. Equal vectors become one point with its k + 1 least ids.
    2. Cells of the projected space are fitted on a sample; every point falls into one.  A cell with more than
       SHARD_ROWS points is dealt into several shards, each with a kd-tree of its own.
    3. A query searches its own cell.  Then it goes on to the cells whose box, by the chi-square test, may still hold
       a vector nearer than its k-th: rows move only where an answer is likely.
    """
    spark = vectors.sparkSession
    prepare(spark)

    def valid(df: DataFrame) -> DataFrame:
        v = F.col("v")
        finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
        return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & (F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0))

    rows = valid(vectors)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = lengths[0]["d"]
    of_one = Window.partitionBy("v").orderBy("id")  # limited to k + 1 rows before its shuffle
    least = rows.filter(F.size("v") == dims).withColumn("r", F.row_number().over(of_one)).filter(F.col("r") <= k + 1)
    points = cut(least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("h", F.xxhash64(F.lit(3), "v")))
    asked = cut(valid(queries).filter(F.size("v") == dims).groupBy("id").agg(F.min("v").alias("v")))
    n = points.count()

    def project(batches):
        for b in batches:
            flat = _vectors(b, dims) @ projection(dims)
            yield pa.RecordBatch.from_arrays([pa.array(list(flat), pa.list_(pa.float64()))], names=["p"])

    share = min(1.0, SAMPLE / max(1, n))
    drawn = points.filter(F.shiftrightunsigned("h", 34) < int(share * (1 << 30))) if share < 1 else points
    sample = drawn.select("v").mapInArrow(project, "p array<double>").toArrow()["p"].combine_chunks().flatten().to_numpy().reshape(-1, PROJECTED)
    shared = spark.sparkContext.broadcast(Cells(sample, -(-n // SHARD_ROWS)))

    def placed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.of(_vectors(b, dims) @ projection(dims)), pa.int32())], names=[*b.schema.names, "cell"])

    where = points.mapInArrow(placed, "v array<double>, ids array<long>, h long, cell int")
    # Counts by cell, SAMPLE / CELL_SAMPLE rows at most.
    sizes = cut(where.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards")))
    shard = where.join(F.broadcast(sizes), "cell").withColumn("shard", F.pmod("h", F.col("shards")).cast("int")).select("cell", "shard", "ids", "v")

    def run(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(ask):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        got = search_shard(own["ids"].tolist(), np.stack(own["v"].to_numpy()), ask["id"].to_numpy(), np.stack(ask["v"].to_numpy()), ask["worst"].to_numpy(), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got, strict=True)))

    def searched(ask: DataFrame) -> DataFrame:
        """ask: id, v, worst and cell.  A cell with many queries meets them in blocks."""
        blocks = cut(ask.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks")))
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        named = lambda df, **new: F.broadcast(df.select(*[F.col(c).alias(x) for x, c in new.items()]))
        left = shard.join(named(blocks, cell="cell", copies="blocks"), "cell").withColumn("block", upto("copies")).select("cell", "shard", "block", "ids", "v")
        right = ask.join(named(blocks, cell="cell", parts="blocks"), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        right = right.join(named(sizes, cell="cell", own="shards"), "cell").withColumn("shard", upto("own")).select("cell", "shard", "block", "id", "v", "worst")
        key = ["cell", "shard", "block"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, schema)

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    infinite = F.lit(float("inf"))
    first = cut(top(searched(asked.mapInArrow(placed, "id long, v array<double>, cell int").withColumn("worst", infinite))))
    reach = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("worst"))
    limit = chi_square_quantile(CONFIDENCE, PROJECTED)

    def beyond(batches):
        for b in batches:
            p = _vectors(b, dims) @ projection(dims)
            own, cells = shared.value.of(p), []
            for q, c, w in zip(p, own, b.column("worst").to_numpy(), strict=True):
                near = shared.value.within(q, limit * w * w)
                cells.append(near[near != c])
            take = pa.array(np.repeat(np.arange(len(b)), [len(c) for c in cells]))
            yield pa.RecordBatch.from_arrays([*(b.column(x).take(take) for x in ("id", "v", "worst")), pa.array(np.concatenate(cells) if cells else [], pa.int32())], names=["id", "v", "worst", "cell"])

    further = cut(asked.join(reach, "id", "left").withColumn("worst", F.coalesce("worst", infinite)).mapInArrow(beyond, "id long, v array<double>, worst double, cell int"))
    second = searched(further)
    return top(first.select("query_id", "vec_id", "score").unionByName(second)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the 10 nearest vectors to each of those whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0), 10)
