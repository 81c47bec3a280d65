"""Substring deduplication: recurring passages, confirmed and located by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.llm.common import cut, drop, finish, gram_hashes, kind_of, prepare, sweep, table, words

#: Words of a window, and of the runs of words (grams) of which each window's least stands for it.
WINDOW, GRAM = 35, 14
#: Recurring grams that all workers hold (8 bytes each, in one array); more are joined with the documents instead.
BROADCAST_GRAMS = 4_000_000
#: Passages (8 bytes each, and about 100 for each document that has some) that all workers hold for the last pass; more
#: are joined with the documents instead.
BROADCAST_PASSAGES = 2_000_000
#: Occurrences of a gram that meet in one group; a more frequent one is dealt over several.
GROUP = 20_000
#: Windows of one stretch at most; a longer one, of a text that repeats itself, is dealt in pieces.
PIECE = 256
#: Windows compiled into one automaton, about 35 nodes each, so that it stays in a core's cache; more take several.
PATTERNS = 1_000
#: Words of the groups that are looked through at once, if a single group has not more.
WORDS = 10_000


def slide(x: np.ndarray, n: int, op: np.ufunc) -> np.ndarray:
    """The least or greatest of each n consecutive values, by doubling."""
    size = 1
    while 2 * size <= n:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def least_grams(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's grams, and for each window the least among its grams.  Equal windows have equal least grams."""
    g = gram_hashes(word_hashes(ws), GRAM).view(np.int64)
    return g, slide(g, WINDOW - GRAM + 1, np.minimum)


def anchors(ws: list[bytes]) -> list[int]:
    """The distinct least grams of a text's windows; several times, if the text itself has the gram at several places."""
    if len(ws) < WINDOW:
        return []
    g, m = least_grams(ws)
    span = WINDOW - GRAM
    low = np.full(span, np.iinfo(np.int64).min)
    chosen = g[slide(np.concatenate([low, m, low]), span + 1, np.maximum) == g]
    values, counts = np.unique(chosen, return_counts=True)
    return np.repeat(values, np.where(counts > 1, 2 + counts // PIECE, 1)).tolist()


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("twin"), pa.array([anchors(words(t)) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))], names=["key", "twin", "grams"])


def stretches(ws: list[bytes], known: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(gram, first word, end) of the runs of windows, PIECE at most, whose least gram is one and the same known one."""
    if len(ws) < WINDOW or not len(known):
        return
    _, m = least_grams(ws)
    hit = known[np.minimum(np.searchsorted(known, m), len(known) - 1)] == m
    if not hit.any():
        return
    edge = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (hit[1:] != hit[:-1]), True])
    for a, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if hit[a]:
            for x in range(a, e, PIECE):
                yield int(m[a]), x, min(x + PIECE, e) + WINDOW - 1


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [(a, e) for a, e in out]


_SPANS = "key long, twin long, start int, stop int, code1 long, code2 long"
_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())


def _batch(columns: list) -> pa.RecordBatch:
    m = len(next(c for c in columns if c is not None))
    return pa.RecordBatch.from_arrays([pa.nulls(m, k) if c is None else pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=[x.split()[0] for x in _SPANS.split(", ")])


class Shard:
    """Groups of stretches with one gram each: what recurs is confirmed, compiled, and located by the automata.

    Windows whose hash occurs twice in a group are confirmed as recurring; of each one representative is compiled.  The
    stretches then run through the automata, which tell every place where a confirmed window's very words stand.  The
    hashes decide nothing by themselves: a window met only once was confirmed by chance and does not count, and places
    that were confirmed but not met have other words, so that they are compiled in another round.
    """

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.groups: list[tuple[list[tuple[int, int, int, np.ndarray]], bool]] = []
        self.held = 0
        self.out: list[pa.RecordBatch] = []

    def add(self, group: list[tuple[int, int, int, bytes]], split: bool) -> None:
        """group: (key, twin, first word, text).  split: other groups have the same gram, so what is alone here may not be."""
        if len(group) == 1 and not split and len(group[0][3].split()) == WINDOW:
            return
        number, new = self.numbers.setdefault, self.numbers
        texts = [(k, t, s, np.array([number(w, len(new)) for w in body.split()], np.int32)) for k, t, s, body in group]
        self.groups.append((texts, split))
        self.held += sum(len(x[3]) for x in texts)
        if self.held >= WORDS:
            self.flush()

    def flush(self) -> None:
        if self.groups:
            texts = [x for own, _ in self.groups for x in own]
            group = np.repeat(np.arange(len(self.groups)), [len(own) for own, _ in self.groups])
            self._locate(texts, group, np.array([split for _, split in self.groups]))
        self.groups, self.held, self.numbers = [], 0, {}

    def _locate(self, texts: list[tuple[int, int, int, np.ndarray]], group: np.ndarray, split: np.ndarray) -> None:
        ids = np.concatenate([x[3] for x in texts])
        size = np.array([len(x[3]) for x in texts])
        text = np.repeat(np.arange(len(texts)), size)
        first = np.r_[0, np.cumsum(size)]
        whole = np.flatnonzero(text[WINDOW - 1 :] == text[: len(ids) - WINDOW + 1])  # starts of windows
        code = gram_hashes(finish(ids.astype(np.uint64) + np.uint64(1)), WINDOW)[whole] ^ finish(group[text[whole]].astype(np.uint64))
        _, at, back, times = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        todo = times[back] > 1  # of the windows, those confirmed and not met yet
        recurs = np.zeros(len(whole), bool)
        place = np.full(len(ids), -1)
        place[whole] = np.arange(len(whole))
        patterns = np.sort(at[times > 1])
        while len(patterns):
            met = self._stream(ids, first, group, text[whole[patterns]], whole[patterns], place)
            for windows in met:
                if len(windows) > 1:
                    recurs[windows] = True
                todo[windows] = False
            left = np.flatnonzero(todo)
            patterns = np.sort(left[np.unique(back[left], return_index=True)[1]])
        self._tell(texts, text, first, whole, recurs, ids, split[group])

    def _stream(self, ids: np.ndarray, first: np.ndarray, group: np.ndarray, owner: np.ndarray, starts: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
        """For each pattern the windows that the automata meet it at, in the texts of its group."""
        of_group = np.searchsorted(group, np.arange(group[-1] + 2))
        for a in range(0, len(starts), PATTERNS):
            machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            for k, p in enumerate(starts[a : a + PATTERNS].tolist()):
                machine.add_word(tuple(ids[p : p + WINDOW].tolist()), k)
            machine.make_automaton()
            hits: list[tuple[int, int]] = []
            edges = [0]
            ran = []
            for g in np.unique(group[owner[a : a + PATTERNS]]).tolist():
                for t in range(of_group[g], of_group[g + 1]):
                    hits.extend(machine.iter(tuple(ids[first[t] : first[t + 1]].tolist())))
                    edges.append(len(hits)), ran.append(first[t])
            if hits:
                found = np.array(hits, np.int64)
                windows = place[found[:, 0] - WINDOW + 1 + np.repeat(ran, np.diff(edges))]
                order = np.argsort(found[:, 1], kind="stable")
                yield from np.split(windows[order], np.flatnonzero(np.diff(found[order, 1])) + 1)

    def _tell(self, texts: list, text: np.ndarray, first: np.ndarray, whole: np.ndarray, recurs: np.ndarray, ids: np.ndarray, split: np.ndarray) -> None:
        at = whole[recurs]
        if len(at):
            own = text[at]
            new = np.r_[True, (own[1:] != own[:-1]) | (at[1:] - at[:-1] > WINDOW)]
            last = np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]
            t, begin, end = own[new], at[new] - first[own[new]], at[last] + WINDOW - first[own[new]]
            key, twin, start = (np.array([x[i] for x in texts], np.int64) for i in range(3))
            self.out.append(_batch([key[t], twin[t], start[t] + begin, start[t] + end, None, None]))
        across = np.flatnonzero(split[text[whole]])
        if len(across):
            names, rows, seen = list(self.numbers), [], set()
            half = lambda x: x - (1 << 64) if x >> 63 else x
            for k in across.tolist():
                p = whole[k]
                code = xxhash.xxh3_128_intdigest(b" ".join(names[i] for i in ids[p : p + WINDOW].tolist()))
                if recurs[k]:  # told once, so that what is alone in another part learns of it
                    if code in seen:
                        continue
                    seen.add(code)
                key, twin, start, _ = texts[text[p]]
                who = (None, None, None) if recurs[k] else (key, twin, start + int(p - first[text[p]]))
                rows.append((*who, None, half(code >> 64), half(code & (1 << 64) - 1)))
            self.out.append(_batch([list(c) for c in zip(*rows, strict=True)]))


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by gram and part, so that a group is read as a stretch of rows."""
    shard, group, now = Shard(), [], None
    for b in batches:
        for gram, part, parts, *row in zip(*(b.column(c).to_pylist() for c in ("gram", "part", "parts", "key", "twin", "start", "body")), strict=True):
            if (gram, part) != now:
                if group:
                    shard.add(group, split)  # noqa: F821
                group, now, split = [], (gram, part), parts > 1
            group.append(tuple(row))
        yield from shard.out
        shard.out.clear()
    if group:
        shard.add(group, split)
    shard.flush()
    yield from shard.out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each text (start << 32 | stop), those that overlap or touch as one."""
    for b in batches:
        own = [[x << 32 | y for x, y in merged([(p >> 32, p & 0xFFFFFFFF) for p in spans])] for spans in b.column("passages").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("twin"), pa.array(own, pa.list_(pa.int64()))], names=["key", "twin", "passages"])


def dedup_substrings(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", outputs: tuple[str, ...] = ("kept_text",)) -> DataFrame:
    """Remove from every whole text each word in a window of WINDOW words that also starts anywhere else.

    Returns one row for each input row: the columns ``keep`` in a struct ``kept``, ``n_words`` and ``n_removed``
    long, and the chosen outputs: ``kept_text`` (the kept words, joined by one space) and ``kept_sha256``.  A null or
    empty text has no words; one with fewer than WINDOW loses none.  Equal texts are each other's copies, so that
    windows of all of them go; rows that are equal in all kept columns too count as so many texts.  Null ids pass
    through, an empty table gives none.  Only the named columns are read.

    1. Each window is stood for by the least of its grams' hashes; grams that are so chosen twice anywhere recur.
    2. Stretches of windows that a recurring gram stands for meet by the gram, in groups of a bounded size.
    3. In a group, windows that recur are confirmed by hashes; one representative of each is compiled into automata of
       a bounded size, and the group's stretches stream through these, which locate every occurrence by its words.
       Windows of a gram with several groups are confirmed across these by a 128-bit hash of their words.
    4. Documents are cut at the passages located.  They are known by 128 bits of their kept columns and text.

    Only stretches stream through automata: the rest of a text has no gram that recurs, and so no window.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.col(f"`{text_col}`").cast("string")
    kept = F.struct(*[F.col(f"`{c}`") for c in keep])
    src = docs.select(kept.alias("kept"), text.alias("text")).withColumns({"key": F.xxhash64("kept", "text"), "twin": F.xxhash64(F.lit(7), "text", "kept")})
    texts = src.select("key", "twin", "text").filter(F.length("text") >= 2 * WINDOW - 1)

    seen = texts.mapInArrow(_gather, "key long, twin long, grams array<long>")
    counted = seen.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    recurring = cut(counted.select("gram", F.ceil(F.col("n") / GROUP).cast("int").alias("parts")))
    n = recurring.count()
    all_grams = n <= BROADCAST_GRAMS
    if all_grams:
        got = recurring.toArrow()
        order = np.argsort(values := got["gram"].to_numpy())
        many = np.flatnonzero((parts := got["parts"].to_numpy()[order]) > 1)
        shared = spark.sparkContext.broadcast((values[order], dict(zip(values[order][many].tolist(), parts[many].tolist(), strict=True))))
        ask = texts.withColumn("grams", F.lit(None).cast("array<long>")).withColumn("parts", F.lit(None).cast("array<int>"))
    else:
        shared = None
        own = seen.select("key", "twin", F.explode(F.array_distinct("grams")).alias("gram")).join(recurring, "gram").groupBy("key", "twin").agg(F.collect_set(F.struct("gram", "parts")).alias("of"))
        ask = texts.join(own, ["key", "twin"]).select("key", "twin", "text", F.col("of.gram").alias("grams"), F.col("of.parts").alias("parts"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, many = shared.value if shared else (None, None)
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for key, twin, t, grams, parts in zip(*(b.column(c).to_pylist() for c in ("key", "twin", "text", "grams", "parts")), strict=True):
                ws = words(t)
                if shared is None:
                    order = np.argsort(own := np.array(grams, np.int64))
                    known, many = own[order], {g: p for g, p in zip(grams, parts, strict=True) if p > 1}
                for gram, a, e in stretches(ws, known):
                    split = many.get(gram, 1)
                    for c, v in zip(cols, (gram, (key + a) % split, split, key, twin, a, b" ".join(ws[a:e])), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["gram", "part", "parts", "key", "twin", "start", "body"])

    stretched = ask.mapInArrow(deal, "gram long, part int, parts int, key long, twin long, start int, body binary")
    located = cut(stretched.repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(_locate, _SPANS))
    drop(recurring)
    if shared:
        shared.destroy()  # workers that live on would keep it
    sweep(spark)
    # Of a window, each part of its gram's texts tells once, so that these groups are small.
    across = located.filter("code1 is not null").groupBy("code1", "code2").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("key", "twin", "start")).alias("at")).filter("n > 1")
    more = across.select(F.explode("at").alias("x")).filter("x.key is not null").select("x.key", "x.twin", "x.start", (F.col("x.start") + WINDOW).alias("stop"))
    passages = located.filter("code1 is null").select("key", "twin", "start", "stop").unionByName(more).groupBy("key", "twin").agg(F.collect_set(F.shiftleft(F.col("start").cast("long"), 32) + F.col("stop")).alias("passages"))
    passages = cut(passages.mapInArrow(_joined, "key long, twin long, passages array<long>"))
    drop(located)
    sweep(spark)
    if (passages.agg(F.sum(F.size("passages"))).first()[0] or 0) <= BROADCAST_PASSAGES:
        passages = F.broadcast(passages)

    kinds = {"kept_text": pa.string(), "kept_sha256": pa.string()}

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone = [], []
            of: dict[str, list[str]] = {c: [] for c in outputs}
            for t, spans in zip(b.column("text").to_pylist(), b.column("passages").to_pylist(), strict=True):
                ws = words(t)
                total.append(len(ws))
                if spans:
                    at, left = 0, []
                    for a, e in merged([(x >> 32, x & 0xFFFFFFFF) for x in spans]):
                        left += ws[at:a]
                        at = e
                    ws = left + ws[at:]
                gone.append(total[-1] - len(ws))
                whole = b" ".join(ws)
                for c in outputs:
                    of[c].append(hashlib.sha256(whole).hexdigest() if c == "kept_sha256" else whole.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), *(pa.array(of[c], kinds[c]) for c in outputs)], names=["kept", "n_words", "n_removed", *outputs])

    ddl = ", ".join([f"kept {kind_of(src.schema['kept'].dataType)}", "n_words long", "n_removed long", *(f"{c} string" for c in outputs)])
    return src.join(passages, ["key", "twin"], "left").select("kept", "text", "passages").mapInArrow(take, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: what substring deduplication leaves of every document."""
    out = dedup_substrings(table(spark, sf_dir, "documents"), outputs=("kept_sha256",))
    return out.select(F.col("kept.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents without their recurring passages; texts that lose nothing stay as they are.

    A document of which nothing is left goes; ``n_chars`` follows the text, if there is such a column.  Nulls, repeats
    and empty tables as in `dedup_substrings`; other columns stay whatever their names.
    """
    out = dedup_substrings(docs, tuple(docs.columns)).filter("n_removed < n_words or n_words = 0")
    less = F.col("n_removed") > 0
    own = {"text": F.when(less, F.col("kept_text")).otherwise(F.col("kept.text")), "n_chars": F.when(less, F.length("kept_text").cast("long")).otherwise(F.col("kept.n_chars"))} if "n_chars" in docs.columns else {"text": F.when(less, F.col("kept_text")).otherwise(F.col("kept.text"))}
    return out.select(*[own[c].alias(c) if c in own else F.col(f"kept.`{c}`").alias(c) for c in docs.columns])
