"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary (hash, displace and compress: a bucket's displacement sends its
keys to free slots, as many slots as keys): a pre-token that is a token costs one hash and one comparison. Tier two
takes the other pre-tokens: their bytes form a linked list, and a heap gives the adjacent pair of lowest rank,
leftmost first, until no pair is a token.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .pieces import Pieces, together

#: Rows that leave a worker at once; long documents stay small in number.
ROWS = 512
_LOW = (1 << 32) - 1


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file by id. Ids must be 0, 1, 2 and so on."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks have gaps")
    return [tokens[i] for i in range(len(tokens))]


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: ``find`` gives a key's index in the list, or -1."""

    def __init__(self, keys: list[bytes], load: int = 4) -> None:
        self.keys, self.size = keys, len(keys)
        self.buckets = max(1, self.size // load)
        self.shift = [0] * self.buckets  # a displacement, or -1 - slot for a bucket of one key
        self.slots = [-1] * self.size
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, i))
        for bucket, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                break
            d = 0
            while True:
                spots = {self._slot(h, d) for h, _ in members}
                if len(spots) == len(members) and all(self.slots[s] < 0 for s in spots):
                    break
                d += 1
                if d > 1 << 22:
                    raise ValueError("keys repeat")
            self.shift[bucket] = d
            for h, i in members:
                self.slots[self._slot(h, d)] = i
        free = (s for s, i in enumerate(self.slots) if i < 0)
        for bucket, members in groups.items():
            if len(members) == 1:
                slot = next(free)
                self.shift[bucket], self.slots[slot] = -1 - slot, members[0][1]

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 32) + d * ((h & _LOW) | 1)) % self.size

    def find(self, key: bytes) -> int:
        if not self.size:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        i = self.slots[-1 - d if d < 0 else self._slot(h, d)]
        return i if self.keys[i] == key else -1


class Codec:
    """Encoder and decoder for one vocabulary and pre-token pattern. What only encoding needs is made when it is asked
    for, and stays out of pickles."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.tokens, self.pattern = tokens, pattern
        self.hash = PerfectHash(tokens)

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    @cached_property
    def pieces(self) -> Pieces:
        return Pieces(regex.compile(self.pattern).findall, self.encode_token)

    @cached_property
    def pairs(self) -> list[int]:
        """The ids of tokens of two bytes, by these; -1 for the others."""
        out = [-1] * 65_536
        for token, i in self.ranks.items():
            if len(token) == 2:
                out[token[0] << 8 | token[1]] = i
        return out

    @cached_property
    def singles(self) -> list[int]:
        """The ids of the tokens of one byte, by it; None where there is none."""
        return [self.ranks.get(bytes([b])) for b in range(256)]

    def __getstate__(self) -> dict:
        return {"tokens": self.tokens, "pattern": self.pattern, "hash": self.hash}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.hash.keys = self.tokens

    def encode_token(self, token: str) -> bytes:
        """Packed ids of a pre-token: the perfect hash for those in the vocabulary, merges for the rest."""
        piece = token.encode()
        whole = self.hash.find(piece)
        if whole >= 0:
            return whole.to_bytes(4, "little")
        return array("i", self.merge(piece)).tobytes()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token: merges by a heap over linked bytes."""
        n, rank, pairs = len(piece), self.ranks.get, self.pairs
        ids = [*map(self.singles.__getitem__, piece)]
        if n == 1:
            return ids
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        now = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        heap = [r << 32 | i for i, r in enumerate(now) if r >= 0]
        now.append(-1)
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & _LOW, top >> 32
            if now[i] != r:
                continue  # one of its parts has changed since
            ids[i], j = r, after[i]
            end = after[i] = after[j]
            now[j] = now[i] = -1
            if end < n:
                before[end] = i
                r = rank(piece[i : after[end]])
                if r is not None:
                    now[i] = r
                    heappush(heap, r << 32 | i)
            p = before[i]
            if p >= 0:
                r = rank(piece[p:end])
                if r is None:
                    now[p] = -1
                else:
                    now[p] = r
                    heappush(heap, r << 32 | p)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.pieces.ids(text), dtype="<i4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec(spark: SparkSession, path: str, pattern: str):
    """A codec sent to the executors once. Its size is that of the vocabulary file."""
    return spark.sparkContext.broadcast(Codec(load_ranks(path), pattern))


def _out_name(df: DataFrame, name: str) -> None:
    if name in df.columns:
        raise ValueError(f"the frame already has a column {name}")


def encode(df: DataFrame, shared, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of df (all by default) and ``out``: the text's token ids.

    Null and empty texts have no ids. Every row gives one row, repeated rows too, in any order; texts of any length
    are encoded whole. A ``keep`` column named like ``out`` is an error.
    """
    keep = df.columns if keep is None else keep
    columns = list(dict.fromkeys([*keep, text]))
    _out_name(df.select(*keep), out)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in together(whole, columns.index(text)):
                flat, sizes = own.pieces.many(batch.column(columns.index(text)).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in keep), ids], names=[*keep, out])

    return df.select(*columns).mapInArrow(run, schema)


def decode(df: DataFrame, shared, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of df (all by default) and ``out``: the bytes that the ids stand for; null for null ids."""
    keep = df.columns if keep is None else keep
    columns = list(dict.fromkeys([*keep, ids]))
    _out_name(df.select(*keep), out)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.BinaryType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                column = batch.column(columns.index(ids))
                flat, ends = column.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum([0, *(column.value_lengths().fill_null(0).to_pylist())]).tolist()
                texts = [own.decode(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                found = pa.array([None if null else x for x, null in zip(texts, column.is_null().to_pylist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in keep), found], names=[*keep, out])

    return df.select(*columns).mapInArrow(run, schema)


def checked(df: DataFrame, shared, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of df (all by default), ``n_tokens``, ``ids`` and ``round_trip``: whether the ids decode to the
    text's bytes. One pass, so that no decoded text leaves its worker. Nulls, repeats and long texts as in
    :func:`encode`; a ``keep`` column named like one of the new ones is an error."""
    keep = df.columns if keep is None else keep
    columns = list(dict.fromkeys([*keep, text]))
    for name in ("n_tokens", "ids", "round_trip"):
        _out_name(df.select(*keep), name)
    new = [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("round_trip", T.BooleanType(), False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in (part for whole in common.slices(batches, 8 * ROWS) for part in together(whole, columns.index(text))):
            texts = batch.column(columns.index(text)).to_pylist()
            flat, sizes = own.pieces.many(texts)
            ends = np.cumsum([0, *sizes])
            exact = [own.decode(flat[a:b].tolist()) == (x or "").encode() for a, b, x in zip(ends, ends[1:], texts, strict=False)]
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in keep), pa.array(sizes), ids, pa.array(exact, pa.bool_())], names=[*keep, "n_tokens", "ids", "round_trip"])

    return df.select(*columns).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *new]))


def digests(docs: DataFrame, shared, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode again, and digest both: one row for each row of docs."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    coded = encode(slim, shared, keep=["doc_id"])
    both = decode(coded, shared)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the 50k byte-level vocabulary."""
    import public_tokenizers

    shared = codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared)

