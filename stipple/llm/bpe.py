"""Byte-level BPE encoding and decoding with a rank queue on a hierarchical bitmap."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.llm.common import column, kind_of, prepare

#: Distinct pre-tokens in each of the two generations that a worker remembers, about 250 bytes each.
CACHE_ENTRIES = 250_000
_LEAF = 8  # 256 ranks in a leaf word of the bitmap
_BIT = [1 << k for k in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token.

    The parts form a linked list.  Each adjacent pair that has a rank sits in the bucket of that rank; a bitmap of
    two levels tells which buckets are filled, and find-first-set on both levels gives the lowest rank.  A bucket's
    positions are taken from the left (most have one, and are that number itself); one whose pair has changed since is
    stale and skipped.  A pair of lower rank that a merge makes goes before what is left of the bucket.  So a pre-token
    of n bytes costs O(n) queue steps, however long it is.
    """
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 2))
    before = list(range(-1, n))
    pair = [get(piece[i : i + 2], -1) for i in range(n)]  # rank of the pair that starts at a position now
    pair[-1] = -1
    buckets: dict[int, int | list[int]] = {}
    leaves: dict[int, int] = {}
    top = 0
    for i, r in enumerate(pair):
        if r >= 0:
            if r in buckets:
                old = buckets[r]
                if old.__class__ is int:
                    buckets[r] = [old, i]
                else:
                    old.append(i)
            else:
                buckets[r] = i
                leaf = r >> _LEAF
                if leaf in leaves:
                    leaves[leaf] |= _BIT[r & 255]
                else:
                    leaves[leaf] = _BIT[r & 255]
                    top |= 1 << leaf
    while top:
        leaf = (top & -top).bit_length() - 1
        bits = leaves[leaf]
        low = bits & -bits
        r = (leaf << _LEAF) + low.bit_length() - 1
        if bits == low:
            del leaves[leaf]
            top ^= 1 << leaf
        else:
            leaves[leaf] = bits ^ low
        at = buckets.pop(r)
        if at.__class__ is int:
            if pair[at] != r:
                continue  # stale
            at = (at,)
        else:
            at.sort()
        done = 0
        for i in at:
            done += 1
            if pair[i] != r:
                continue
            j = after[i]
            end = after[j]
            pair[j] = -1
            after[i] = end
            least = r
            if end < n:
                before[end] = i
                pair[i] = q = get(piece[i : after[end]], -1)
                if q >= 0:
                    if q in buckets:
                        old = buckets[q]
                        if old.__class__ is int:
                            buckets[q] = [old, i]
                        else:
                            old.append(i)
                    else:
                        buckets[q] = i
                        k = q >> _LEAF
                        if k in leaves:
                            leaves[k] |= _BIT[q & 255]
                        else:
                            leaves[k] = _BIT[q & 255]
                            top |= 1 << k
                        if q < r:
                            least = q
            else:
                pair[i] = -1
            p = before[i]
            if p >= 0:
                pair[p] = q = get(piece[p:end], -1)
                if q >= 0:
                    if q in buckets:
                        old = buckets[q]
                        if old.__class__ is int:
                            buckets[q] = [old, p]
                        else:
                            old.append(p)
                    else:
                        buckets[q] = p
                        k = q >> _LEAF
                        if k in leaves:
                            leaves[k] |= _BIT[q & 255]
                        else:
                            leaves[k] = _BIT[q & 255]
                            top |= 1 << k
                        if q < least:
                            least = q
            if least < r:
                if done < len(at):
                    buckets[r] = at[done:]
                    leaves[leaf] = leaves.get(leaf, 0) | low
                    top |= 1 << leaf
                break
    out, i = [], 0
    while i < n:
        k = after[i]
        out.append(ranks[piece[i:k]])
        i = k
    return out


class Codec(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers; missing ones are merged on demand.

    What is looked up and not found here may be in the generation before, which goes when this one is full: so frequent
    pre-tokens stay.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.former: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.former.get(piece)
        if packed is None:
            ids = merge(piece.encode("utf-8"), self.ranks)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.former = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text))) if text else b""

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for a worker; its rank file is part of the tokenizer's package on every machine."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns one row for each input row: the id column as ``doc_id``, optionally the column ``carry`` unchanged as
    ``carried``, and the chosen outputs: ``ids`` array<int>, ``decoded`` string, ``n_tokens`` long, ``ids_sha256``,
    ``decoded_sha256`` and ``exact`` boolean (the round trip gave the text).  A null or empty text has no ids, and
    decodes to the empty text.  A null id, repeated rows and an empty table pass through; other columns are ignored
    whatever their names.  A very long pre-token takes the same queue as a short one.
    """
    prepare(docs.sparkSession)
    kinds = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "exact": pa.bool_()}
    spark_kinds = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "exact": "boolean"}
    cols = [F.col(f"`{id_col}`").alias("doc_id"), column(docs, text_col, "string").alias("text")]
    if carry:
        cols.append(F.col(f"`{carry}`").alias("carried"))
    src = docs.select(*cols)
    head = ["doc_id", *(["carried"] if carry else [])]
    ddl = ", ".join([*(f"{c} {kind_of(src.schema[c].dataType)}" for c in head), *(f"{c} {spark_kinds[c]}" for c in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            got: dict[str, list] = {c: [] for c in outputs}
            for text in b.column("text").to_pylist():
                packed = own.encode(text)
                back = own.decode(packed) if packed else b""
                for c, rows in got.items():
                    if c == "ids":
                        rows.append(memoryview(packed).cast("I").tolist() if packed else [])
                    elif c == "decoded":
                        rows.append(back.decode("utf-8"))
                    elif c == "n_tokens":
                        rows.append(len(packed) // 4)
                    elif c == "ids_sha256":
                        rows.append(hashlib.sha256(packed).hexdigest())
                    elif c == "decoded_sha256":
                        rows.append(hashlib.sha256(back).hexdigest())
                    else:
                        rows.append(back == (text or "").encode("utf-8"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in head), *(pa.array(got[c], kinds[c]) for c in outputs)], names=[*head, *outputs])

    return src.mapInArrow(run, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: digests of the ids and of the decoded bytes of every document."""
    import public_tokenizers

    from stipple.llm.common import table

    return bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
