"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.llm.common import cut, drop, finish, gathered, kind_of, prepare, table

#: Edits of words that a passage may have, as a share of the item's words (rounded down).
EDITS = 0.2
#: Repetitions of the embedding, and sampled places in each: chosen for a recall of 0.95 at the most edits of any kind,
#: at any place and up to 60 words; with fewer edits or mixed ones it is 0.99 and more.
REPEATS, SAMPLED = 24, 2
#: Items that one pass over the documents looks for; more take more passes.
BLOCK_ITEMS = 10_000
#: Bytes of text that are looked through at once, if a single Arrow batch doesn't hold more.
FIND_BYTES = 4 << 20
_TABLE = 20  # bits of the table of word pairs
#: Punctuation that normalising takes away, and spaces beyond ASCII that part words.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WIDE_PUNCTUATION = "“”‘’«»…–—"
WIDE_SPACES = "\u00a0\u2009\u202f\u3000"
_WIDE = [(x.encode(), b"") for x in WIDE_PUNCTUATION] + [(x.encode(), b" ") for x in WIDE_SPACES]


def normal_words(text: str | None) -> list[bytes]:
    """Words in lower case without punctuation, in UTF-8."""
    if not text:
        return []
    raw = text.lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION)
    if not raw.isascii():
        for old, new in _WIDE:
            raw = raw.replace(old, new)
    return raw.split()


def hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def allowed(n: int) -> int:
    """Edits that a passage may have for an item of n words."""
    return int(n * EDITS + 1e-9)


class Walks:
    """REPEATS random walks over windows of one length, and the places that each samples.

    The walk: at each step a window shows the word under its pointer, and a random bit for (step, word) moves the
    pointer on or not.  Windows with few edits soon walk in step again, so that they differ in few of the shown
    words; a key hashes SAMPLED of these.  Of the embedding's 3 L steps, the last third shows mostly the padding after
    the window's end (two steps a word on average), so that the walk stops after 2 L.
    """

    def __init__(self, length: int, seed: int = 41):
        rng = np.random.default_rng((seed, length))
        steps = 2 * length
        self.length = length
        self.odd = rng.integers(0, 1 << 63, (steps, REPEATS, 1), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.sampled = np.zeros((steps, REPEATS, 1), bool)
        for r in range(REPEATS):
            self.sampled[rng.choice(steps, min(SAMPLED, steps), replace=False), r] = True
        self.last = int(np.flatnonzero(self.sampled.any(1))[-1])

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """Bucket keys (REPEATS x n) of rows of word hashes (n x L; 0 pads)."""
        n = len(windows)
        padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1).ravel()
        base = np.arange(n) * (self.length + 1)
        at = np.zeros((REPEATS, n), np.int64)
        key = np.broadcast_to(np.arange(REPEATS, dtype=np.uint64)[:, None], (REPEATS, n)).copy()
        for t in range(self.last + 1):
            shown = padded[base + np.minimum(at, self.length)]
            if self.sampled[t].any():
                key = np.where(self.sampled[t], finish(key * np.uint64(0x9E3779B97F4A7C15) + shown), key)
            at += (finish(shown * self.odd[t]) >> np.uint64(63)).astype(np.int64)
        return key


def passage_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """The passage of `text` nearest to the item in edits of words: (edits, start, end), or None beyond `most`.

    The dynamic program over the item's words is exact; of equal passages the first end counts, then the longest.
    """
    n = len(text)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for i, w in enumerate(item.tolist(), 1):
        step = np.empty(n + 1, np.int64)
        from_ = np.empty(n + 1, np.int64)
        step[0], from_[0] = i, 0
        swap, skip = cost[:-1] + (text != w), cost[1:] + 1
        own = np.minimum(swap, skip)
        own_from = np.where(swap <= skip, start[:-1], start[1:])
        # a run of extra words of the text: the least of step[k] + (j - k), by a running minimum
        step[1:], from_[1:] = own, own_from
        level = step - np.arange(n + 1)
        low = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == low, np.arange(n + 1), 0))
        step, from_ = low + np.arange(n + 1), from_[source]
        cost, start = step, from_
        if cost.min() > most:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), end) if cost[end] <= most else None


class Items:
    """One block of benchmark items, with what finds them: pairs of words, and buckets for each window length."""

    def __init__(self, rows: list[tuple[object, str | None]]):
        self.ids, self.words = [], []
        for i, text in rows:
            w = hashes(normal_words(text))
            if len(w):
                self.ids.append(i), self.words.append(w)
        by: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            by.setdefault(len(w), []).append(k)
        self.single: dict[int, list[int]] = {}
        for k in by.pop(1, []):
            self.single.setdefault(int(self.words[k][0]), []).append(k)
        self.lengths = sorted(by)
        self.walks = {length: Walks(length) for length in self.lengths}
        self.buckets: dict[int, dict[int, list[int]]] = {}
        pairs: dict[int, set[int]] = {}
        for c, length in enumerate(self.lengths):
            own = self.buckets[length] = {}
            for row in self.walks[length].keys(np.stack([self.words[k] for k in by[length]])).tolist():
                for k, key in zip(by[length], row, strict=True):
                    own.setdefault(key, []).append(k)
            for k in by[length]:
                for p in self.pair(self.words[k]).tolist():
                    pairs.setdefault(p, set()).add(c)
        self.pairs = np.array(sorted(pairs), np.uint64)
        self.of_length = np.zeros((len(pairs), len(self.lengths)), bool)
        for i, p in enumerate(self.pairs.tolist()):
            self.of_length[i, list(pairs[p])] = True
        self.seen = np.zeros(1 << _TABLE, bool)
        self.seen[self.pairs >> np.uint64(64 - _TABLE)] = True

    @staticmethod
    def pair(w: np.ndarray) -> np.ndarray:
        return finish(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])

    def candidates(self, w: np.ndarray, doc: np.ndarray) -> set[tuple[int, int]]:
        """(window start, item) pairs that share a bucket.  w: the words of many documents, doc: whose they are.

        A window can only be within `allowed` edits of an item if so many of its word pairs are pairs of items of
        this length: an edit breaks two at most.  This loses nothing and leaves few windows to embed.
        """
        out: set[tuple[int, int]] = set()
        if self.single:
            for p in np.flatnonzero(np.isin(w, np.array(list(self.single), np.uint64))).tolist():
                out.update((p, k) for k in self.single[int(w[p])])
        if len(w) < 2 or not self.lengths:
            return out
        pair = self.pair(w)
        at = np.flatnonzero(self.seen[pair >> np.uint64(64 - _TABLE)] & (doc[1:] == doc[:-1]))
        which = np.minimum(np.searchsorted(self.pairs, pair[at]), len(self.pairs) - 1)
        known = self.pairs[which] == pair[at]
        at, which = at[known], which[known]
        firsts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        for c, length in enumerate(self.lengths):
            need = max(1, length - 1 - 2 * allowed(length))
            hits = at[self.of_length[which, c]]
            if len(hits) < need:
                continue
            last = hits[need - 1 :]
            close = np.flatnonzero(last - hits[: len(last)] <= length - 2)
            if not len(close):
                continue
            low, high = last[close] - (length - 2), hits[close]  # starts of windows that hold all these hits
            starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(low.tolist(), high.tolist(), strict=True)]))
            starts = starts[(starts >= 0) & (starts < len(w))]
            left = np.searchsorted(doc, doc[starts], "right") - starts  # words up to the document's end
            # a passage at the end may lack words of the item: what is left there is a window too, padded
            fits = left >= length - allowed(length)
            starts, left = starts[fits], left[fits]
            windows = w[np.minimum(starts[:, None] + np.arange(length), len(w) - 1)]
            windows[np.arange(length) >= left[:, None]] = 0
            self._meet(length, starts, windows, out)
            # a passage that lacks words is mostly met by windows that start before it; at a text's start these are padded
            begun = firsts[np.searchsorted(hits, firsts + length - 1) - np.searchsorted(hits, firsts) >= need]
            if len(begun) and allowed(length):
                size = np.searchsorted(doc, doc[begun], "right") - begun
                shift = np.tile(np.arange(1, allowed(length) + 1), len(begun))[:, None]
                begun, size = np.repeat(begun, allowed(length)), np.repeat(size, allowed(length))
                place = np.arange(length) - shift
                windows = w[np.clip(begun[:, None] + place, 0, len(w) - 1)]
                windows[place >= size[:, None]] = 0
                windows[place < 0] = 1  # any word: at 0 a walk would not move on
                self._meet(length, begun, windows, out)
        return out

    def _meet(self, length: int, starts: np.ndarray, windows: np.ndarray, out: set[tuple[int, int]]) -> None:
        if len(starts):
            bucket = self.buckets[length]
            for row in self.walks[length].keys(windows).tolist():
                for p, key in zip(starts.tolist(), row, strict=True):
                    if key in bucket:
                        out.update((p, k) for k in bucket[key])

    def short(self, w: np.ndarray, doc: np.ndarray) -> set[tuple[int, int]]:
        """Documents a little shorter than an item hold no window of its size; they are windows themselves, padded."""
        out: set[tuple[int, int]] = set()
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(doc)])
        for length in self.lengths:
            own = np.flatnonzero((sizes < length) & (sizes >= length - allowed(length)))
            if len(own):
                windows = np.zeros((len(own), length), np.uint64)
                for i, o in enumerate(own):
                    windows[i, : sizes[o]] = w[starts[o] : starts[o] + sizes[o]]
                self._meet(length, starts[own], windows, out)
        return out

    def regions(self, found: set[tuple[int, int]], doc: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Candidates of one item that overlap in one document, as one stretch of words: (document, item, start, end)."""
        now = None
        for k, p in sorted((k, p) for p, k in found):
            d, n = int(doc[p]), len(self.words[k])
            begin, end = max(int(first[d]), p - allowed(n)), min(int(first[d + 1]), p + n + allowed(n))
            if now and now[:2] == (d, k) and begin <= now[3]:
                now = (d, k, now[2], max(now[3], end))
            else:
                if now:
                    yield now
                now = (d, k, begin, end)
        if now:
            yield now

    def find(self, texts: list[str | None]) -> list[list[tuple[object, int, int, int]]]:
        """For each text its leaks (item id, edits, first word, words of the passage), the best place for each item."""
        words = [normal_words(t) for t in texts]
        sizes = np.array([len(x) for x in words], np.int64)
        w = hashes([x for ws in words for x in ws])
        doc = np.repeat(np.arange(len(texts)), sizes)
        first = np.r_[0, np.cumsum(sizes)]
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        for d, k, begin, end in self.regions(self.candidates(w, doc) | self.short(w, doc), doc, first):
            found = passage_distance(self.words[k], w[begin:end], allowed(len(self.words[k])))
            if found:
                edits, s, e = found
                place = (edits, begin - int(first[d]) + s, e - s)
                best[d][k] = min(best[d].get(k, place), place)
        return [[(self.ids[k], *place) for k, place in sorted(of.items())] for of in best]


def find_leaks(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Passages of benchmark items in every whole text.

    Returns one row for each input row: the columns ``keep`` in a struct ``kept``, and ``leaks``, an array of structs
    (item_id, edits int, start int, n_words int), one for each item of which the text has a passage within EDITS of
    its words, at its best place.  Words are compared in lower case without punctuation.  Null and empty texts have
    no leaks, null and empty items are in no text; an item of fewer than five words must occur as it is.  Repeated
    rows and items are each judged; an empty table gives none.  Only the named columns are read.

    Items are taken to the driver in blocks of a fixed size and broadcast, one block at a time; each is a pass over the
    documents, and all passes but the last are written.
    """
    spark = docs.sparkSession
    prepare(spark)
    ask = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")).filter(F.length(F.trim("text")) > 0)
    kind = kind_of(ask.schema["item_id"].dataType)
    blocks = max(1, -(-ask.count() // BLOCK_ITEMS))
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text_col}`").cast("string").alias("text"))
    leaks = f"array<struct<item_id:{kind},edits:int,start:int,n_words:int>>"
    out = src.withColumn("leaks", F.lit(None).cast(leaks))
    before = None
    for block in range(blocks):
        rows = ask.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in rows]))
        names = ["kept", "text", "leaks"] if block < blocks - 1 else ["kept", "leaks"]  # the last pass needs no text behind it

        def run(batches: Iterator[pa.RecordBatch], shared=shared, names=names) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in gathered(batches, "text", FIND_BYTES):
                found = own.find(b.column("text").to_pylist())
                known = b.column("leaks").to_pylist() if b.column("leaks").null_count < len(b) else [None] * len(b)
                leaks = [(x or []) + [dict(zip(("item_id", "edits", "start", "n_words"), y, strict=True)) for y in f] for x, f in zip(known, found, strict=True)]
                of = {"kept": b.column("kept"), "text": b.column("text"), "leaks": pa.array(leaks, b.schema.field("leaks").type)}
                yield pa.RecordBatch.from_arrays([of[n] for n in names], names=names)

        out = out.mapInArrow(run, ", ".join({"kept": f"kept {kind_of(src.schema['kept'].dataType)}", "text": "text string", "leaks": f"leaks {leaks}"}[n] for n in names))
        if block < blocks - 1:  # one block at a time: the next begins when this one's items are gone
            out = cut(out)
            shared.destroy()
            if before is not None:
                drop(before)
            before = out
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document with a passage of a benchmark item, and the item."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("kept.doc_id").alias("doc_id"), F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.edits", "x.start", "x.n_words")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents without a passage of `benchmark`, unchanged; nulls, repeats and ties as in `find_leaks`."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), tuple(docs.columns)).filter(F.size("leaks") == 0).select("kept.*")
