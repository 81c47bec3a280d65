"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix; DataFrame functions only."""

from __future__ import annotations

import bisect
import itertools
import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stipple.llm.common import cut, table

#: Numbers of the matrix at most: source partitions times shards.
MATRIX = 1 << 20
#: Source partitions at most; of more, Spark joins neighbours without moving rows.
PARTITIONS = 1 << 12
#: Rows that a range of a shard's slots should hold on average, and the bits of the number of such ranges.
ROWS_EACH, RANGE_BITS = 100_000, 16


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """An exact draw of how many of `draws` taken without return are good.

    Weights of all counts within the reach of doubles are built outwards from the mode by their ratios, so neither
    factorials nor a limit on the population is needed.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    up, down = [1.0], []
    k, w = mode, 1.0
    while k < high and w > 1e-18:
        w *= (good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1))
        k += 1
        up.append(w)
    k, w = mode, 1.0
    while k > low and w > 1e-18:
        w *= k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1))
        k -= 1
        down.append(w)
    sums = list(itertools.accumulate(down[::-1] + up))
    return mode - len(down) + bisect.bisect_left(sums, rng.random() * sums[-1])


def matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each partition, how many of its rows go to each shard, drawn as a uniform shuffle of all rows would give."""
    rng, n = random.Random(seed), sum(counts)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    out = []
    for count in counts:
        row, left, rest = [], count, sum(room)
        for s in range(shards):
            rest -= room[s]
            k = hypergeometric(rng, room[s], rest, left) if left else 0
            row.append(k)
            left -= k
        room = [a - k for a, k in zip(room, row, strict=True)]
        out.append(row)
    return out


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """Deal all rows into `shards` shards in a uniformly random order.

    Returns the input's columns with ``shard`` int (0 to shards - 1) and ``slot`` long (the place in the shard,
    gapless from 0).  Shard sizes differ by one at most (law ``rows``).  An input column of one of these two names is
    replaced, others stay whatever their names.  Nulls in any column, ties and repeated rows are dealt like other
    rows: each row draws its place from a hash of its number among the rows read.  An empty table gives none.

    1. Local permutation: every source partition, as it lies, is sorted by a random key and written to the shared
       checkpoint folder with the partition's number and each row's place, so that these never change.
    2. The driver gets the partitions' counts and draws the matrix: how many rows of each go to each shard.
    3. A partition's places are cut by its row of the matrix; the one exchange moves rows to (shard, range of a second
       random key).
    4. Permutation of what arrived: the order of the second key gives the slots.
    """
    if not 1 <= shards <= 1 << 16:
        raise ValueError("shards must be from 1 to 65536")
    plain = rows.drop("shard", "slot")
    drawn = plain.select(F.struct(*[F.col(f"`{c}`") for c in plain.columns]).alias("kept"), F.monotonically_increasing_id().alias("number"))
    drawn = drawn.coalesce(max(1, min(PARTITIONS, MATRIX // shards)))
    drawn = drawn.select("kept", F.xxhash64(F.lit(seed), "number").alias("key"), F.xxhash64(F.lit(seed + 1), "number").alias("second"))
    at = F.monotonically_increasing_id()
    own = cut(drawn.sortWithinPartitions("key", "second").select("kept", "second", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    counts = {r["part"]: r["n"] for r in own.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, parts = sum(counts.values()), sorted(counts)
    dealt = matrix([counts[p] for p in parts], shards, seed)
    # MATRIX numbers at most: small enough to broadcast by its bound.
    ends = rows.sparkSession.createDataFrame([(p, list(itertools.accumulate(row))) for p, row in zip(parts, dealt, strict=True)], "part int, ends array<long>")
    bits = min(RANGE_BITS, max(0, math.ceil(math.log2(max(1, total / shards / ROWS_EACH)))))
    range_ = F.shiftrightunsigned("second", 64 - bits).cast("int") if bits else F.lit(0)
    placed = own.join(F.broadcast(ends), "part").select("kept", "second", "part", "place", F.size(F.filter("ends", lambda e: e <= F.col("place"))).cast("int").alias("shard"), range_.alias("range"))
    # Counts of (shard, range) give each range its first slot: shards x 2^bits rows, one for ROWS_EACH rows of the table.
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    first = F.broadcast(first) if shards << bits <= MATRIX else first
    again = Window.partitionBy("shard", "range").orderBy("second", "part", "place")
    out = placed.withColumn("slot", F.row_number().over(again) - 1).join(first, ["shard", "range"])
    return out.select("kept.*", "shard", (F.col("first") + F.col("slot")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents into 16 shards under the law ``rows``; only digests of the texts are moved."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_into_shards(docs, 16).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
