"""Language-model scores by context-tree weighting over bytes, beside a smoothed unigram score over words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.llm.common import column, cut, drop, kind_of, lower_words, prepare, sweep, table

#: Bytes of context at the deepest level of the tree, 3 to 6: a run of these and the byte after them fits 63 bits.
DEPTH = 5
#: Entries of the byte model that all workers may hold (about 50 bytes each); a larger model is joined with the texts' runs.
SLICE = 4_000_000
#: Runs that are worked on at once, if those of one context of three bytes are not more.
CHUNK = 100_000
#: Distinct runs that a task holds while it gathers them; what it tells is summed up after the shuffle.
GATHERED = 1_000_000
#: Words, the most frequent ones, whose counts each worker holds (16 bytes each); others are joined.
HEAD = 1 << 18
_WORDS, _RUNS = 0, 1


def _hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws)).view(np.int64)


def runs(data: bytes) -> np.ndarray:
    """Each byte with the DEPTH before it (zeros before the first): the newest context byte highest, the byte lowest."""
    b = np.frombuffer(b"\0" * DEPTH + data, np.uint8).astype(np.int64)
    n = len(data)
    out = b[DEPTH : DEPTH + n].copy()
    for d in range(1, DEPTH + 1):  # the d-th byte back
        out |= b[DEPTH - d : DEPTH - d + n] << 8 * (DEPTH + 1 - d)
    return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([c for _, c in parts])[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
    return x[first], np.diff(np.r_[first, len(x)])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words in training texts; counts in training texts of the runs of all texts, zeros included."""
    ws: Counter[bytes] = Counter()
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def out(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["kind", "key", "n"])

    for b in batches:
        own: dict[bool, list[np.ndarray]] = {True: [], False: []}
        for text, train in zip(b.column("text").to_pylist(), b.column("train").to_pylist(), strict=True):
            if train:
                ws.update(lower_words(text))
            if text:
                own[train].append(runs(text.encode("utf-8", "surrogatepass")))
        for train, found in own.items():
            if found:
                keys, counts = _unique(np.concatenate(found))
                parts.append((keys, counts if train else np.zeros_like(counts)))
        if sum(len(k) for k, _ in parts) > GATHERED:
            parts = [_merged(parts)]
            if len(parts[0][0]) > GATHERED // 2:
                yield out(_RUNS, *parts.pop())
        if len(ws) > 1_000_000:
            yield out(_WORDS, _hashes(list(ws)), np.fromiter(ws.values(), np.int64, len(ws)))
            ws.clear()
    if parts:
        yield out(_RUNS, *_merged(parts))
    if ws:
        yield out(_WORDS, _hashes(list(ws)), np.fromiter(ws.values(), np.int64, len(ws)))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of the texts of every part; some may be told more than once."""
    held: dict[int, list[np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for p, found in held.items():
            keys = np.unique(np.concatenate(found))
            for at in range(0, len(keys), 100_000):
                own = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), p, np.int32)), pa.array(own)], names=["part", "key"])
        held.clear()

    for b in batches:
        for p, text in zip(b.column("part").to_pylist(), b.column("text").to_pylist(), strict=True):
            if text:
                held.setdefault(p, []).append(runs(text.encode("utf-8", "surrogatepass")))
        if sum(len(x) for found in held.values() for x in found) > 8_000_000:
            for p, found in held.items():
                held[p] = [np.unique(np.concatenate(found))]
            if sum(len(found[0]) for found in held.values()) > 4_000_000:
                yield from out()
    yield from out()


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of at least 0.5: the recurrence up to 8 and more, then Stirling's series."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift[small] += np.log(y[small])
        y[small] += 1
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - shift


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - math.log(math.pi) - _log_gamma(n0 + n1 + 1.0)


class Level:
    """All (context, bit node) pairs of one depth: counts, the node's estimate and weighted probability."""

    def __init__(self, ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.ids, inverse = np.unique(ids, return_inverse=True)
        size = len(self.ids)
        self.n0, self.n1 = np.bincount(inverse, n0, size), np.bincount(inverse, n1, size)
        estimate = kt_block(self.n0, self.n1)
        if below is None:  # the deepest
            self.weighted, self.own = estimate, np.ones(size)
        else:
            self.weighted = np.logaddexp(estimate, np.bincount(inverse, below, size)) - math.log(2)
            self.own = np.exp(estimate - math.log(2) - self.weighted)

    def above(self, depth: int) -> Level:
        """The level of the contexts that are one byte shorter; this one's contexts have `depth` bytes."""
        return Level((self.ids >> 16) << 8 | self.ids & 255 if depth > 1 else self.ids & 255, self.n0, self.n1, self.weighted)

    def mix(self, ids: np.ndarray, bit: np.ndarray, deeper: np.ndarray | float) -> np.ndarray:
        at = np.searchsorted(self.ids, ids)
        n0, n1, own = self.n0[at], self.n1[at], self.own[at]
        return own * (np.where(bit, n1, n0) + 0.5) / (n0 + n1 + 1.0) + (1 - own) * deeper


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For eight bits of each run's byte, high bit first: nodes of the byte's binary tree, and bits."""
    x = keys & 255
    j = np.arange(8)[:, None]
    return (1 << j) | (x >> (8 - j)), (x >> (7 - j)) & 1


def _context(keys: np.ndarray, depth: int) -> np.ndarray:
    return keys >> 8 * (DEPTH + 1 - depth)


def _levels(keys: np.ndarray, n: np.ndarray) -> list[Level]:
    """Depths DEPTH down to 3, for all runs of whole contexts of three bytes."""
    node, bit = _bits(keys)
    counts = np.broadcast_to(n, bit.shape).astype(np.float64)
    out = [Level((_context(keys, DEPTH) << 8 | node).ravel(), (counts * (1 - bit)).ravel(), (counts * bit).ravel(), None)]
    for depth in range(DEPTH, 3, -1):
        out.append(out[-1].above(depth))
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, in batches of about CHUNK that hold whole contexts of three bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size >= CHUNK:
            whole = pa.concat_batches(held)
            ctx = _context(whole.column("key").to_numpy(), 3)
            at = int(np.searchsorted(ctx, ctx[-1]))
            if at:
                yield whole.slice(0, at)
            held, size = [whole.slice(at)], len(whole) - at
    if size:
        yield pa.concat_batches(held)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth 2 of the tree: ids (context of two bytes, node), counts and weighted probabilities."""
    parts: list[tuple[np.ndarray, ...]] = []

    def told(two: Level) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (two.ids, two.n0, two.n1, two.weighted, two.own)], names=["id", "n0", "n1", "weighted", "own"])

    for b in _chunks(batches):
        three = _levels(b.column("key").to_numpy(), b.column("n").to_numpy())[-1]
        parts.append(((three.ids >> 16) << 8 | three.ids & 255, three.n0, three.n1, three.weighted))
        ids, n0, n1, below = (np.concatenate(x) for x in zip(*parts, strict=True))
        done = ids >> 8 < ids[-1] >> 8  # the last pair may go on
        if done.any():
            yield told(Level(ids[done], n0[done], n1[done], below[done]))
        parts = [tuple(x[~done] for x in (ids, n0, n1, below))]
    if parts:
        yield told(Level(*parts[0]))


def byte_model(grams: DataFrame) -> DataFrame:
    """log10 probability of the last byte of each run after the bytes before it: ``key`` long, ``logp`` double.

    A context tree of bytes, newest first, to DEPTH; the byte is coded by the seven inner nodes of a binary tree it
    passes, each with its own counts and weights.  With the counts frozen, a bit's probability is the mixture over all
    depths by their posterior weights.

    Runs are dealt by their two newest bytes and sorted, so that a worker holds the runs of one context of three bytes,
    or about CHUNK, at once (2^24 at most at DEPTH 5).  A first pass gives the nodes of depth 2; sums of these, 2^16 numbers
    at most, make depth 1 and the root on the driver; a second pass, in which a pair's nodes come before its runs, mixes.
    """
    spark = grams.sparkSession
    pair = F.shiftright("key", 8 * (DEPTH - 1))
    runs_ = grams.select(pair.alias("pair"), "key", "n")
    two = cut(runs_.repartition("pair").sortWithinPartitions("key").select("key", "n").mapInArrow(_pairs, "id long, n0 double, n1 double, weighted double, own double"))
    sums = two.groupBy((F.shiftright("id", 16).bitwiseAND(F.lit(255)) * 256 + F.col("id").bitwiseAND(F.lit(255))).alias("id")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below")).toArrow()
    one = Level(sums["id"].to_numpy().astype(np.int64), *(sums[c].to_numpy() for c in ("n0", "n1", "below")))
    root = one.above(1)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0)]

        def runs_only() -> Iterator[pa.RecordBatch]:
            for b in batches:
                node = b.filter(pa.compute.is_valid(b.column("own")))
                if len(node):  # a pair's nodes come before its runs, and are kept while these may come
                    for k, c in enumerate(("id", "n0", "n1", "own")):
                        above[k] = np.concatenate([above[k], node.column(c).to_numpy()])
                yield b.filter(pa.compute.is_null(b.column("own"))).select(["key", "n"])

        for b in _chunks(x for x in runs_only() if len(x)):
            keys = b.column("key").to_numpy()
            levels = _levels(keys, b.column("n").to_numpy())
            node, bit = _bits(keys)
            p: np.ndarray | float = 0.5
            for depth, level in zip(range(DEPTH, 2, -1), levels, strict=True):
                p = level.mix(_context(keys, depth) << 8 | node, bit, p)
            keep = above[0] >> 8 >= _context(keys[:1], 2)[0]
            above[:] = [x[keep] for x in above]
            order = np.argsort(above[0])
            pairs = Level.__new__(Level)
            pairs.ids, pairs.n0, pairs.n1, pairs.own = (x[order] for x in above)
            for depth, level in ((2, pairs), (1, one), (0, root)):
                p = level.mix(_context(keys, depth) << 8 | node if depth else node, bit, p)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.log10(p).sum(0))], names=["key", "logp"])

    null = F.lit(None).cast("double")
    nodes = two.select(F.shiftright("id", 8).alias("pair"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("n"), "id", "n0", "n1", "own")
    both = nodes.unionByName(runs_.select("pair", "key", "n", F.lit(None).cast("long").alias("id"), null.alias("n0"), null.alias("n1"), null.alias("own")))
    model = cut(both.repartition("pair").sortWithinPartitions("pair", F.col("key").asc_nulls_first()).mapInArrow(second, "key long, logp double"))
    drop(two)
    sweep(spark)
    return model


class Lookup:
    """Keys of 63 bits to values: a few hash tables, each for what found its slot taken in those before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables = []
        keys = keys.astype(np.uint64)
        rng = np.random.default_rng(8)
        while len(keys):
            bits = max(8, int(len(keys) * 2 - 1).bit_length())
            mult = np.uint64(int(rng.integers(1 << 40, 1 << 62)) | 1)
            slot = keys * mult >> np.uint64(64 - bits)
            slots, first = np.unique(slot, return_index=True)
            own, held = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits)
            own[slots], held[slots] = keys[first] + np.uint64(1), values[first]
            self.tables.append((mult, np.uint64(64 - bits), own, held))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values; 0 for a key that isn't there."""
        keys = keys.astype(np.uint64)
        out, at = np.zeros(len(keys)), None
        for mult, shift, own, held in self.tables:
            slot = keys * mult >> shift
            hit = own[slot] == keys + np.uint64(1)
            found = np.where(hit, held[slot], 0.0)
            if at is None:
                out = found
                at = np.flatnonzero(~hit)
            else:
                out[at] = found
                at = at[~hit]
            keys = keys[~hit]
            if not len(keys):
                break
        return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text; learn from those for which crc32(id as text) mod 7 is not 2.

    Returns one row for each input row: ``doc_id``, ``held_out`` boolean, ``n_tokens``, ``n_known``, ``train_tokens``
    long, ``base_score`` double (words: one added to each count), ``score`` double (bytes: context-tree weighting),
    both log10 probabilities, and ``bits_per_byte`` double (the code length; null for an empty text).  A null text
    counts as empty: one token, the end.  A null id counts as the empty text in the checksum.  Repeated rows count
    and are scored each; an empty table gives none; without training texts all counts are 0.  Other columns are
    ignored whatever their names.

    Words stand by 64-bit hashes.  The most frequent ones (HEAD) go to all workers; the rest, of which none is
    frequent, are joined with the counts.  A byte model of at most SLICE runs goes to all workers.  Of a larger one, each
    partition of the texts gets the runs that it has itself, by a join; texts are then written and moved once.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), column(docs, text_col, "string").alias("text"))
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    src = src.withColumn("train", train)
    gathered = cut(src.select("text", "train").mapInArrow(_gather, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    vocabulary = gathered.filter(F.col("kind") == _WORDS).select("key", "n")
    sums = {r["kind"]: r for r in gathered.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    ends = src.filter("train").count()
    total, distinct = ends, int(ends > 0)
    if _WORDS in sums:
        total, distinct = total + sums[_WORDS]["n"], distinct + sums[_WORDS]["v"]
    runs_seen = sums[_RUNS]["v"] if _RUNS in sums else 0

    # The least count of a frequent word: the driver sees how many words have each of the greatest counts, HEAD at most.
    least, room = 0, HEAD
    for r in vocabulary.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(HEAD).toLocalIterator():
        room -= r["words"]
        if room < 0:
            least = r["n"] + 1
            break
    head = vocabulary.filter(F.col("n") >= least).toArrow()
    order = np.argsort(keys := head["key"].to_numpy())
    head_keys = spark.sparkContext.broadcast((keys[order], head["n"].to_numpy()[order]))
    whole = least == 0  # then no word is left to join
    unit, end_known, end_value = math.log10(total + distinct + 1), int(ends > 0), math.log10(ends + 1)

    model = byte_model(gathered.filter(F.col("kind") == _RUNS).select("key", "n")) if runs_seen else None
    rows = src.select("doc_id", "text", (~F.col("train")).alias("held_out")).withColumn("rid", F.monotonically_increasing_id())
    kind = kind_of(src.schema["doc_id"].dataType)

    def scored(b: pa.RecordBatch, lookup: Lookup | None) -> pa.RecordBatch:
        keys, counts = head_keys.value
        logs = np.log10(counts + 1.0)
        n_tokens, n_known, base, got, size, tails, times = [], [], [], [], [], [], []
        for text in b.column("text").to_pylist():
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            size.append(len(raw))
            got.append(float(lookup(runs(raw)).sum()) if raw and lookup else 0.0)
            of = Counter(lower_words(text))
            h, n = _hashes(list(of)), np.fromiter(of.values(), np.int64, len(of))
            at = np.searchsorted(keys, h)
            hit = (keys[np.minimum(at, len(keys) - 1)] == h) if len(keys) else np.zeros(len(h), bool)
            n_tokens.append(int(n.sum()) + 1)
            n_known.append(int(n[hit].sum()) + end_known)
            base.append(float((n[hit] * logs[at[hit]]).sum()) + end_value - n_tokens[-1] * unit)
            tails.append([] if whole else h[~hit].tolist())
            times.append([] if whole else n[~hit].tolist())
        cols = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(got, pa.float64()), pa.array(size, pa.int64()), pa.array(tails, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), b.column("rid"), *cols], names=["doc_id", "held_out", "rid", "n_tokens", "n_known", "base", "score", "size", "tail", "times"])

    out = f"doc_id {kind}, held_out boolean, rid long, n_tokens long, n_known long, base double, score double, size long, tail array<long>, times array<long>"
    if runs_seen <= SLICE:
        own = model.toArrow() if model is not None else None
        values = spark.sparkContext.broadcast((own["key"].to_numpy(), own["logp"].to_numpy()) if own is not None else None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lookup = Lookup(*values.value) if values.value else None
            for b in batches:
                yield scored(b, lookup)

        done = rows.mapInArrow(run, out)
    else:
        rows = cut(rows.withColumn("part", F.spark_partition_id()))
        known = rows.select("part", "text").mapInArrow(_asked, "part int, key long").join(model, "key")
        none = F.lit(None)
        told = known.select("part", "key", "logp", none.cast(kind).alias("doc_id"), none.cast("string").alias("text"), none.cast("boolean").alias("held_out"), none.cast("long").alias("rid"))
        both = told.unionByName(rows.select("part", none.cast("long").alias("key"), none.cast("double").alias("logp"), "doc_id", "text", "held_out", "rid"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: list[tuple[np.ndarray, np.ndarray]] = []
            lookup, now = None, None
            for b in batches:  # a part's runs come before its texts
                for p in np.unique(b.column("part").to_numpy()).tolist():
                    of = b.filter(pa.compute.equal(b.column("part"), p))
                    if p != now:
                        parts, lookup, now = [], None, p
                    found = of.filter(pa.compute.is_valid(of.column("key")))
                    texts = of.filter(pa.compute.is_null(of.column("key")))
                    if len(found):
                        parts.append((found.column("key").to_numpy(), found.column("logp").to_numpy()))
                    if len(texts):
                        if lookup is None and parts:
                            at, first = np.unique(np.concatenate([k for k, _ in parts]), return_index=True)
                            lookup, parts = Lookup(at, np.concatenate([v for _, v in parts])[first]), []
                        yield scored(texts, lookup)

        done = both.repartition("part").sortWithinPartitions("part", F.col("key").asc_nulls_last()).mapInArrow(run, out)
    if not whole:
        own = F.struct("doc_id", "held_out", "n_tokens", "n_known", "base", "score", "size")
        # One row for the document itself, under a key of its own that no count is added for, and one for each rare word.
        this = F.array(F.struct(F.xxhash64("rid").alias("key"), F.lit(0).cast("long").alias("n"), own.alias("doc")))
        word = F.transform(F.arrays_zip("tail", "times"), lambda x: F.struct(x["tail"].alias("key"), x["times"].alias("n"), F.lit(None).cast(f"struct<{_doc_type(src)}>").alias("doc")))
        flat = done.select("rid", F.inline(F.concat(this, word)))
        rare = vocabulary.filter(F.col("n") < least)
        counted = flat.join(rare.select("key", F.col("n").alias("c")), "key", "left")
        sure = F.col("c").isNotNull()
        summed = counted.groupBy("rid").agg(
            F.first("doc", ignorenulls=True).alias("doc"),
            F.sum("doc.score").alias("score"),
            F.sum(F.when(sure, F.col("n")).otherwise(0)).alias("known"),
            F.sum(F.when(sure, F.col("n") * F.log10(F.col("c") + 1.0)).otherwise(0.0)).alias("more"),
            F.max("doc.n_tokens").alias("n_tokens"),
            F.max("doc.n_known").alias("n_known"),
            F.max("doc.base").alias("base"),
        )
        done = summed.select("doc.doc_id", "doc.held_out", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), (F.col("base") + F.col("more")).alias("base"), "score", "doc.size")
    bits = F.when(F.col("size") > 0, -F.col("score") * math.log2(10) / F.col("size"))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", bits.alias("bits_per_byte"))


def _doc_type(src: DataFrame) -> str:
    return f"doc_id:{kind_of(src.schema['doc_id'].dataType)},held_out:boolean,n_tokens:bigint,n_known:bigint,base:double,score:double,size:bigint"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: scores of all documents."""
    return score(table(spark, sf_dir, "documents"))
