"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stipple.llm.common import cut, drop, finish, gram_hashes, kind_of, lower_words, prepare, sweep, table
from stipple.llm.components import components
from stipple.llm.substrings import word_hashes

#: Words of a shingle, and the least similarity, in hundredths.
SHINGLE, LEAST = 5, 80
#: A task tells so many of its most frequent shingles; of all, so many (16 bytes each) go to all workers.
TOLD, FREQUENT = 8192, 1 << 17
#: Prefixes that a document can choose from, by the number of tokens that must match in them.
MATCHES = (1, 2, 3, 4, 6, 8)
#: Other documents expected behind a token that isn't known to be frequent.
ELSEWHERE = 0.1
#: Rows of one frequent token that meet in one part, about.
PART = 50_000
#: Ids that all workers may hold as one side of a join.
BROADCAST_ROWS = 500_000
#: Pairs to verify that one text has in one part, about.
PAIRS = 1_000
#: Documents of a bucket, chosen by hashes, that all its others are compared with at first.
PIVOTS = 16
#: Rounds of such comparisons at most, as long as the pairs left are more than so many times the index's rows.
TURNS, WORTH = 2, 8
#: Tokens before a shared one that tell whether it is a pair's first.
LOOK_BACK = 4
#: Words of 64 bits of a set's bitmap, which bounds what two sets can share.
BITMAP = 8


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of runs of five words, in order; of the whole sequence, if there are fewer words."""
    w = word_hashes(lower_words(text))
    return np.unique(gram_hashes(w, min(SHINGLE, len(w)))) if len(w) else np.empty(0, np.uint64)


def signature(s: np.ndarray, twins: frozenset[int] = frozenset()) -> tuple[int, int]:
    """A set by two 63-bit numbers; the first stands for it, or the second if it is one of `twins`.

    Equal sets are one document in what follows.  A first number that two different sets have is found by its second.
    """
    both = xxhash.xxh3_128_intdigest(s.tobytes())
    low, high = both & (1 << 63) - 1, both >> 65
    return (high, low) if low in twins else (low, high)


def bitmap(s: np.ndarray) -> list[int]:
    flags = np.zeros(64 * BITMAP, np.uint8)
    flags[s & np.uint64(64 * BITMAP - 1)] = 1
    return np.packbits(flags).view(np.int64).tolist()


def least_overlap(n: int) -> int:
    """Tokens that a set of n shares with any set it links with, at least."""
    return -(-n * LEAST // 100)


class Order:
    """The global order of tokens, rare ones first: by known frequency, then by hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]

    def frequency(self, s: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[at] == s, self.counts[at], 0)

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Tokens of the chosen prefix in the global order, their known frequencies, and the matches it asks for.

        A set links only with sets that share `least_overlap` of its tokens, so that of the first
        n - least_overlap + l tokens of both, l are shared.  A longer prefix costs index rows; a candidate costs its
        verification, and of a prefix's expected meetings at most one in l shares l tokens.  The cheapest l is taken.
        """
        f = self.frequency(s)
        known = f > 0
        if known.any():
            last = np.flatnonzero(known)
            last = last[np.argsort(f[last], kind="stable")]
            order = np.concatenate([np.flatnonzero(~known), last])
            s, f = s[order], f[order]
        n, need = len(s), least_overlap(len(s))
        met = np.cumsum(np.maximum(f - 1.0, ELSEWHERE))
        best = min((n - need + m + met[n - need + m - 1] / m * n / 16, m) for m in MATCHES if m <= need)[1]
        size = n - need + best
        return s[:size], f[:size], best


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its set's signature and size; of the task its most frequent shingles."""
    names = ["doc_id", "row1", "row2", "sig", "other", "n", "bits", "token", "times"]
    seen: set[int] = set()
    parts: list[np.ndarray] = []
    kept: tuple[np.ndarray, np.ndarray] | None = None
    held, id_type = 0, None

    def fold() -> None:
        nonlocal kept, parts, held
        x, c = np.unique(np.concatenate(parts), return_counts=True)
        parts, held = [], 0
        if kept is not None:
            x, inverse = np.unique(np.concatenate([kept[0], x]), return_inverse=True)
            c = np.bincount(inverse, np.concatenate([kept[1], c])).astype(np.int64)
        more = np.flatnonzero(c > 2)
        if len(more) > TOLD:
            more = more[np.argpartition(c[more], len(more) - TOLD)[-TOLD:]]
        kept = x[more], c[more]

    for b in batches:
        id_type = b.column("doc_id").type
        sigs, others, sizes, bits = [], [], [], []
        for t in b.column("text").to_pylist():
            s = shingles(t)
            sig, other = signature(s) if len(s) else (None, None)
            sigs.append(sig), others.append(other), sizes.append(len(s)), bits.append(bitmap(s) if len(s) else None)
            if len(s) and sig not in seen:
                seen.add(sig)
                parts.append(s)
                held += len(s)
        if held > 2_000_000:
            fold()
        nothing = pa.nulls(len(b), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row1"), b.column("row2"), *(pa.array(x, pa.int64()) for x in (sigs, others, sizes)), pa.array(bits, pa.list_(pa.int64())), nothing, nothing], names=names)
    if parts:
        fold()
    if kept is not None and len(kept[0]):
        m = len(kept[0])
        yield pa.RecordBatch.from_arrays([pa.nulls(m, id_type), *(pa.nulls(m, pa.int64()) for _ in range(5)), pa.nulls(m, pa.list_(pa.int64())), pa.array(kept[0].view(np.int64)), pa.array(kept[1].astype(np.int64))], names=names)


# A document's row under a token: its place (28 bits), its set's size (28), the matches its prefix asks for (4) and
# the level of the token, 0 if it is in all prefixes (4), in one number.
def _pack(place: np.ndarray, n: int, ask: int, level: np.ndarray) -> np.ndarray:
    return place.astype(np.int64) | np.int64(n) << 28 | np.int64(ask) << 56 | level.astype(np.int64) << 60


def _field(name: str, side: str = "") -> Column:
    at, bits = {"place": (0, 28), "n": (28, 28), "ask": (56, 4), "level": (60, 3)}[name]
    return F.shiftright(f"{side}info", at).bitwiseAND(F.lit((1 << bits) - 1))


def _overlap(nx: Column, ny: Column) -> Column:
    """Tokens that two sets of these sizes share if they link, at least."""
    return F.ceil((nx + ny) * LEAST / (100 + LEAST))


def _prefixes(order, twins: frozenset[int]) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Order = order.value
        seen: set[int] = set()
        for b in batches:
            tokens, sigs, infos, salts, dealt = [], [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t)
                if not len(s) or (sig := signature(s, twins)[0]) in seen:
                    continue
                seen.add(sig)
                token, f, ask = own.prefix(s)
                base = len(s) - least_overlap(len(s)) + 1
                place = np.arange(len(token))
                tokens.append(token.view(np.int64)), sigs.append(np.full(len(token), sig))
                infos.append(_pack(place, len(s), ask - 1, np.maximum(place - base + 1, 0)))
                parts = f // PART + 1
                salts.append(np.where(parts > 1, (token ^ np.uint64(sig)) % parts.astype(np.uint64), 0).astype(np.int32)), dealt.append(parts.astype(np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, sigs, infos, salts, dealt)], names=["token", "sig", "info", "part", "parts"])

    return run


_ROWS = "token long, part int, parts int, sig long, info long"
_MET = "a long, b long, k int, ask int, rest int, total int, hub int"


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token and part, in batches that hold whole buckets."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        token, part = b.column("token").to_numpy(), b.column("part").to_numpy()
        if not len(token):
            continue
        last = int(np.flatnonzero((token != token[-1]) | (part != part[-1]))[-1]) + 1 if token[0] != token[-1] or part[0] != part[-1] else 0
        if held and (last or (token[0], part[0]) != key):
            yield pa.concat_batches([*held, b.slice(0, last)])
            held = []
        elif last:
            yield b.slice(0, last)
        held.append(b.slice(last))
        key = token[-1], part[-1]
    if held:
        yield pa.concat_batches(held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets that several documents share, each once, and what documents share with their buckets' pivots.

    Rows come sorted by token, part and signature; a bucket is one part of one token.  Pivots are chosen by hashes
    that are alike in all buckets.  The others of a token dealt over several parts may be in another part.
    """
    held: list[tuple[np.ndarray, ...]] = []
    names = [x.split()[0] for x in f"{_ROWS}, {_MET}".split(", ")]

    def told() -> pa.RecordBatch:
        a, b, ask, rest, total, hub = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        cols = [a[first], b[first], np.diff(np.r_[first, len(a)]), ask[order][first], np.maximum.reduceat(rest[order], first), total[order][first], np.add.reduceat(hub[order], first)]
        m = len(first)
        return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *map(pa.array, cols[:2]), *(pa.array(c.astype(np.int32)) for c in cols[2:])], names=names)

    for b in _bucketed(batches):
        token, part, sig = (b.column(c).to_numpy() for c in ("token", "part", "sig"))
        edge = np.r_[True, (token[1:] != token[:-1]) | (part[1:] != part[:-1])]
        b = b.filter(pa.array(edge | np.r_[True, sig[1:] != sig[:-1]]))
        token, part, parts, sig, info = (b.column(c).to_numpy() for c in ("token", "part", "parts", "sig", "info"))
        edge = np.r_[True, (token[1:] != token[:-1]) | (part[1:] != part[:-1])]
        size = np.diff(np.r_[np.flatnonzero(edge), len(edge)])
        keep = np.repeat(size > 1, size) | (parts > 1)
        if not keep.any():
            continue
        b = b.filter(pa.array(keep)).select(["token", "part", "parts", "sig", "info"])
        m = len(b)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *(pa.nulls(m, pa.int32()) for _ in range(5))], names=names)
        token, part, sig, info = (b.column(c).to_numpy() for c in ("token", "part", "sig", "info"))
        start = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[start, m])
        group = np.repeat(np.arange(len(start)), size)
        order = np.lexsort((finish(sig.view(np.uint64)), group))
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m) - np.repeat(start, size)
        n, ask, level, left = info >> 28 & (1 << 28) - 1, info >> 56 & 15, info >> 60 & 7, (info >> 28 & (1 << 28) - 1) - (info & (1 << 28) - 1)
        for k in range(min(PIVOTS, int(size.max()) - 1)):
            pivot = order[np.minimum(start + k, m - 1)][group]
            x = np.flatnonzero((size[group] > k) & (rank > k))
            y = pivot[x]
            few = np.minimum(ask[x], ask[y])
            fit = (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * LEAST) & (level[x] <= few) & (level[y] <= few)
            x, y, few = x[fit], y[fit], few[fit]
            if len(x):
                held.append((np.minimum(sig[x], sig[y]), np.maximum(sig[x], sig[y]), few, np.minimum(left[x], left[y]), n[x] + n[y], np.where(sig[y] < sig[x], 1, -1)))
        if sum(len(h[0]) for h in held) > 1_000_000:
            yield told()
    if held:
        yield told()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    words_held = 0

    def of(sig: int, text: str) -> np.ndarray:
        nonlocal words_held
        if sig not in held:
            if words_held > 2_000_000:
                held.clear()
                words_held = 0
            held[sig] = shingles(text)
            words_held += len(held[sig])
        return held[sig]

    for b in batches:
        a_out, b_out = [], []
        for a, c, ta, tc in zip(*(b.column(x).to_pylist() for x in ("a", "b", "ta", "tb")), strict=True):
            x, y = of(a, ta), shingles(tc)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= LEAST * (len(x) + len(y) - both):
                a_out.append(a), b_out.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """doc_id, text, and 128 bits (row1, row2) that a row is known by; rows that repeat in both share them."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)
    return src.withColumns({"row1": F.xxhash64("doc_id", "text"), "row2": F.xxhash64(F.lit(7), "text", "doc_id")})


def _number(survey: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """The survey with a set's number in ``sig``, and the first numbers that different sets share (few, if any)."""
    shared = survey.filter("sig is not null").groupBy("sig").agg(F.min("other").alias("x"), F.max("other").alias("y")).filter("x <> y")
    twins = frozenset(r["sig"] for r in shared.select("sig").collect())
    if twins:  # of 10^11 sets a few hundred, by chance
        survey = survey.withColumn("sig", F.when(F.col("sig").isin(*twins), F.col("other")).otherwise(F.col("sig")))
    return survey, twins


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each row doc_id, row1, row2, n, and grp: what its component is known by (null without shingles)."""
    spark = docs.sparkSession
    prepare(spark)
    src = _keyed(docs, id_col, text_col)
    kind = kind_of(src.schema["doc_id"].dataType)
    written = cut(src.mapInArrow(_survey, f"doc_id {kind}, row1 long, row2 long, sig long, other long, n long, bits array<long>, token long, times long"))
    survey, twins = _number(written)
    ids = survey.filter("row1 is not null").select("doc_id", "row1", "row2", "sig", "n")
    bits = [f"b{k}" for k in range(BITMAP)]
    bits_of = survey.filter("sig is not null").select("sig", "n", *[F.col("bits")[k].alias(f"b{k}") for k in range(BITMAP)]).dropDuplicates(["sig"])
    told = survey.filter("token is not null").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(FREQUENT).toArrow()
    tokens, times = told["token"].to_numpy(), told["times"].to_numpy()
    order = spark.sparkContext.broadcast(Order(tokens.view(np.uint64), times))

    index = src.select("text").mapInArrow(_prefixes(order, twins), "token long, sig long, info long, part int, parts int")
    met = cut(index.repartition("token", "part").sortWithinPartitions("token", "part", "sig").mapInArrow(_meet, f"{_ROWS}, {_MET}"))
    order.destroy()  # workers that live on would keep it
    sweep(spark)
    rows = met.filter("token is not null").select("token", "part", "parts", "sig", "info")
    rows_of = ids.filter("sig is not null").groupBy("sig", "row1", "row2").agg(F.count(F.lit(1)).alias("times")).groupBy("sig").agg(F.min(F.struct("row1", "row2", "times")).alias("x")).select("sig", "x.row1", "x.row2", "x.times")
    # A bit of one bitmap that the other lacks stands for a token that isn't shared, which bounds the overlap.
    alone = lambda a, b: sum(F.bit_count(F.col(f"{a}_{c}").bitwiseAND(F.bitwise_not(f"{b}_{c}"))) for c in bits)
    near = lambda a, b, na, nb: F.least(na - alone(a, b), nb - alone(b, a)) >= _overlap(na, nb)

    def linked(pairs: DataFrame, bounded: bool = False) -> DataFrame:
        """Of candidate pairs (a, b), those that are links, by the whole sets.  Many pairs may have one text as a."""
        if not bounded:
            for end in ("a", "b"):
                pairs = pairs.join(bits_of.select(*[F.col(c).alias(end if c == "sig" else f"{end}_{c}") for c in bits_of.columns]), end)
            pairs = pairs.filter(near("a", "b", F.col("a_n"), F.col("b_n"))).select("a", "b")
        pairs = cut(pairs)
        often = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("parts")).filter("parts > 1")
        hubs = cut(often)
        ends = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
        asked = cut(ends.join(rows_of, "sig"))
        count, most = asked.agg(F.count(F.lit(1)), F.max("times")).first()
        if not count:
            drop(hubs, asked)
            return pairs
        texts = src.select("row1", "row2", "text").join(_small(asked, count), ["row1", "row2"]).select("sig", "text")
        texts = cut(texts if most == 1 else texts.dropDuplicates(["sig"]))
        hub = _small(hubs, hubs.count())
        part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        dealt = pairs.join(hub, "a", "left").select("a", "b", part.alias("part"))
        spread = texts.select(F.col("sig").alias("a"), F.col("text").alias("ta")).join(hub, "a", "left")
        spread = spread.select("a", "ta", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        both = dealt.join(texts.select(F.col("sig").alias("b"), F.col("text").alias("tb")), "b").join(spread, ["a", "part"])
        links = cut(both.select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long"))
        drop(pairs, hubs, asked, texts)
        sweep(spark)
        return links

    def side(name: str, df: DataFrame, *more: str) -> DataFrame:
        return df.select("token", "part", *[F.col(c).alias(f"{name}_{c}") for c in ("sig", "info", *more)])

    def shared(found: DataFrame) -> DataFrame:
        """Pairs that may link, from what they share (a, b, k, ask, rest, total, hub).

        Of the tokens in the shorter of both prefixes as many must be shared as it asks for, and after the first
        shared token enough must be left.  The one that is more often a pivot becomes a.
        """
        by = found.groupBy("a", "b").agg(F.sum("k").alias("k"), F.first("ask").alias("ask"), F.max("rest").alias("rest"), F.first("total").alias("total"), F.sum("hub").alias("hub"))
        fit = by.filter((F.col("k") > F.col("ask")) & (F.col("rest") * (100 + LEAST) >= F.col("total") * LEAST))
        return fit.select(F.when(F.col("hub") > 0, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("hub") > 0, F.col("b")).otherwise(F.col("a")).alias("b"))

    def compared(met: DataFrame) -> DataFrame:
        """The same for rows (x_sig, x_info, y_sig, y_info), one for each token that x shares with a pivot y."""
        nx, ny = _field("n", "x_"), _field("n", "y_")
        ask = F.least(_field("ask", "x_"), _field("ask", "y_"))
        fit = met.filter((F.least(nx, ny) * 100 >= F.greatest(nx, ny) * LEAST) & (_field("level", "x_") <= ask) & (_field("level", "y_") <= ask))
        left = F.least(nx - _field("place", "x_"), ny - _field("place", "y_"))
        return shared(fit.select(F.least("x_sig", "y_sig").alias("a"), F.greatest("x_sig", "y_sig").alias("b"), F.lit(1).alias("k"), ask.alias("ask"), left.alias("rest"), (nx + ny).alias("total"), F.when(F.col("y_sig") < F.col("x_sig"), 1).otherwise(-1).alias("hub")))

    def pivots(of: DataFrame, turn: int) -> DataFrame:
        """Some documents of each bucket, chosen by hashes that are alike in all buckets."""
        best = [F.min(F.struct(F.xxhash64(F.lit(turn * PIVOTS + k), "sig").alias("h"), "sig", "info")).alias(f"p{k}") for k in range(PIVOTS)]
        few = F.array_distinct(F.array(*[F.struct(F.col(f"p{k}.sig").alias("sig"), F.col(f"p{k}.info").alias("info")) for k in range(PIVOTS)]))
        return of.groupBy("token", "part").agg(*best).select("token", "part", F.explode(few).alias("p")).select("token", "part", F.col("p.sig").alias("y_sig"), F.col("p.info").alias("y_info"))

    # First each bucket's documents are compared with a few of them only: in a large group most then hang together.
    # Where many don't, those beside a bucket's largest component are compared with a few others of it, and so on.
    size = rows.count()
    found = [linked(shared(met.filter("a is not null").select("a", "b", "k", "ask", "rest", "total", "hub")))]
    for turn in range(1, TURNS + 1):
        links = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        comps = components(links)
        marked = rows.join(_small(comps.withColumnRenamed("node", "sig"), comps.count()), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
        counts = marked.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("parts").alias("parts"))
        mixed = counts.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("comps"), F.max("parts").alias("parts")).filter("comps > 1")
        mixed = mixed.select("token", F.col("m.comp").alias("main"), "all", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        open_rows = cut(marked.join(mixed, ["token", "part"]))
        drop(comps)
        sweep(spark)
        left = open_rows.filter("comp <> main").agg(F.sum("all")).first()[0] or 0
        if left <= size * WORTH or turn == TURNS:
            break
        new = linked(compared(side("x", open_rows.filter("comp <> main")).join(pivots(open_rows.filter("comp = main"), turn), ["token", "part"])))
        found.append(new)
        if new.isEmpty():
            break
        drop(open_rows)
    drop(met)

    # Then what is left: pairs of different components.  In each bucket the largest component is met by the others'
    # documents, which are few there, but not by itself; these go to all parts of a token.
    # A pair is told at its first shared token, where enough of both must be left to reach the overlap that it needs.
    # Tokens before that one aren't shared; looking back over a few leaves out nearly all later meetings.
    back = Window.partitionBy("sig").orderBy(_field("place"))
    told = cut(open_rows.join(bits_of.drop("n"), "sig").withColumn("before", F.array(*[F.lag("token", k).over(back) for k in range(1, LOOK_BACK + 1)])))
    sweep(spark)
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    light = side("x", told.filter("comp <> main").withColumn("part", every_part), "comp", "before", *bits)
    every = side("y", told, "comp", "main", "before", *bits)
    nx, ny = _field("n", "x_"), _field("n", "y_")
    left = F.least(nx - _field("place", "x_"), ny - _field("place", "y_"))
    other = (F.col("x_comp") != F.col("y_comp")) & ((F.col("y_comp") == F.col("y_main")) | (F.col("x_sig") < F.col("y_sig")))
    pairs = light.join(every, ["token", "part"]).filter(other & (left >= _overlap(nx, ny)) & near("x", "y", nx, ny) & ~F.coalesce(F.arrays_overlap("x_before", "y_before"), F.lit(False)))
    pairs = cut(pairs.select(F.col("y_sig").alias("a"), F.col("x_sig").alias("b")).distinct())
    drop(told)
    sweep(spark)
    # Then as many tokens must be shared in the shorter of both prefixes as it asks for.
    own = open_rows.groupBy("sig").agg(F.collect_list(F.struct(_field("place").alias("place"), "token")).alias("pre"), F.first(_field("n")).alias("n"), F.first(_field("ask")).alias("ask"))
    asking = pairs
    for end in ("a", "b"):
        asking = asking.join(own.select(*[F.col(c).alias(end if c == "sig" else f"{end}_{c}") for c in own.columns]), end)
    need, ask = _overlap(F.col("a_n"), F.col("b_n")), F.least("a_ask", "b_ask") + 1
    prefix = lambda end: F.transform(F.filter(f"{end}_pre", lambda x: x["place"] < F.col(f"{end}_n") - need + ask), lambda x: x["token"])
    found.append(linked(asking.filter(F.size(F.array_intersect(prefix("a"), prefix("b"))) >= ask).select("a", "b"), bounded=True))
    drop(pairs, open_rows)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    whole = components(links)
    groups = ids.join(whole.select(F.col("node").alias("sig"), "comp"), "sig", "left")
    groups = cut(groups.select("doc_id", "row1", "row2", "n", F.coalesce("comp", "sig").alias("grp")))
    drop(written, whole, *found)
    sweep(spark)
    return groups


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and find components.

    Returns one row for each input row: ``doc_id``, ``n_shingles`` long (distinct shingles) and ``component_id``, the
    least id of the component.  A text with fewer words has its whole sequence as its one shingle; without words
    (null, empty, blank) the set is empty and linked with nothing, and the component is the row's own id.  Equal sets
    are linked.  Null ids are the least of a component only where it has no other; repeated rows are rows; an empty
    table gives none.  Only the named columns are read.  Words and shingles stand by 64-bit hashes.
    """
    groups = _groups(docs, id_col, text_col)
    least = groups.filter("grp is not null").groupBy("grp").agg(F.min("doc_id").alias("least"))
    out = groups.join(least, "grp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("grp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without near-duplicates: of each component the row with the least id; rows without words all stay.

    Columns stay as they are, whatever their names.  Of rows that repeat in id and text one stays; a row with a null id
    stays only where its component has no other; an empty table gives none.
    """
    groups = _groups(docs, id_col, text_col)
    some = groups.filter("grp is not null")
    stay = some.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row1", "row2")).alias("x")).select("grp", F.col("x.row1").alias("r1"), F.col("x.row2").alias("r2"))
    gone = cut(some.join(stay, "grp").filter("row1 <> r1 or row2 <> r2").select("row1", "row2").distinct())
    twice = cut(some.groupBy("row1", "row2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("row1", "row2"))
    drop(groups)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept")
    rows = _keyed(docs.select(whole, F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "doc_id", "text", "kept")
    key = ["row1", "row2"]
    left = rows.join(_small(gone, gone.count()), key, "left_anti")
    many = twice.count()
    if many:  # rows that repeat in id and text are copies as well
        same = _small(twice, many)
        left = left.join(same, key, "left_anti").unionByName(left.join(same, key, "left_semi").dropDuplicates(key))
    return left.select("kept.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: shingle counts and components of all documents."""
    return join_components(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each group of near-duplicates, with nulls, ties and repeats as in `keep_one`."""
    return keep_one(docs)
