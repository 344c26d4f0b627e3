"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level k holds chunk k of every id that has one, a bitmap that
tells which of these ids go on in level k + 1, and a rank directory: the ones before every 512th bit. Token i is read
from level 0 at i; while its bit is set, its place in the next level is the rank of that bit. No block is decoded.

A shard file: magic, then unsigned 64-bit little-endian numbers (documents, documents with a null id, tokens,
levels), the ids of the documents (signed 64-bit), the start of each document and the end of the last (unsigned
64-bit), then for each level its length (64-bit), its chunks, its bitmap and its directory (32-bit). Shards hold whole
documents in ascending order of document id (nulls first) and are written once, under names that no other attempt of
a task uses; the manifest, a table, names those of the attempts that counted.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .pieces import BUDGET, Pieces, together

MAGIC = b"DACTOK01"
SPAN = 512
#: Tokens after which a shard is closed (at the end of a document).
SHARD_TOKENS = 4_000_000
#: Rows of a batch that are looked at together.
ROWS = 4096
_ID = attrgetter("id")
MANIFEST = "part long, seq long, path string, n_docs long, n_tokens long, n_bytes long"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others,
    in order, for the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class LibraryPieces:
    """Ids of texts as the tokenizers library gives them, whose model gets each unknown pre-token once (see
    :class:`pieces.Pieces`). Without a pattern of pre-tokens the library encodes whole texts; so it does a text that
    holds the string of one of the tokenizer's added tokens, in which that string is one token."""

    def __init__(self, json: str, pattern: str | None, budget: int = BUDGET) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.holds = regex.compile("|".join(map(regex.escape, strings))).search if strings else lambda text: None
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.pieces = Pieces(regex.compile(pattern).findall, self._token, budget) if pattern else None

    def _token(self, token: str) -> bytes:
        word = token[1:]
        plain = token[0] == " " and word.isascii() and word.isalpha()
        letters = self.letters[32] + word if plain else token.encode().decode("latin-1").translate(self.letters)
        return array("i", map(_ID, self.model.tokenize(letters))).tobytes()

    def _apart(self, text: str) -> bytes | None:
        if self.pieces and not self.holds(text):
            return None
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str | None) -> bytes:
        """The ids of a text, four bytes each, little-endian; none for null."""
        return self.many([text])[0].tobytes()

    def many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and how many each has; none for null."""
        if self.pieces:
            return self.pieces.many(texts, self._apart)
        packed = [self._apart(x) if x else b"" for x in texts]
        return np.frombuffer(b"".join(packed), "<i4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4


class Tokenizing:
    """What executors need to encode: the tokenizer's JSON (as large as its file), the pattern of its pre-tokens if it is
    byte-level without a normaliser, and the library made of it once."""

    def __init__(self, path: str, pattern: str | None = None) -> None:
        with open(path, encoding="utf-8") as file:
            self.json = file.read()
        self.pattern = pattern
        self.made: LibraryPieces | None = None

    def __getstate__(self) -> dict:
        return {"json": self.json, "pattern": self.pattern, "made": None}

    def many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if self.made is None:
            self.made = LibraryPieces(self.json, self.pattern)
        return self.made.many(texts)


def pack(doc_ids: list[int | None], texts: list[np.ndarray]) -> bytes:
    """A shard of these documents: their ids in order, nulls first, and the tokens of each."""
    nulls = sum(i is None for i in doc_ids)
    if any(i is None for i in doc_ids[nulls:]):
        raise ValueError("documents with a null id come first")
    rest = np.concatenate(texts, dtype=np.uint32, casting="unsafe") if texts else np.zeros(0, np.uint32)
    starts = np.cumsum([0, *map(len, texts)]).astype("<u8")
    head, levels = [np.array([i or 0 for i in doc_ids], "<i8").tobytes(), starts.tobytes()], []
    total = len(rest)
    while len(rest) or not levels:
        more = rest >= 256
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), SPAN), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = (np.cumsum(counts) - counts).astype("<u4")
        levels.append(np.array([len(rest)], "<u8").tobytes() + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
    return b"".join([MAGIC, np.array([len(doc_ids), nulls, total, len(levels)], "<u8").tobytes(), *head, *levels])


@dataclass
class Shard:
    """A shard in memory: ``shard[i]`` reads one token, ``all()`` every one."""

    data: bytes
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.data[:8] != MAGIC:
            raise ValueError("not a token shard")
        docs, nulls, self.tokens, levels = map(int, np.frombuffer(self.data, "<u8", 4, 8))
        at = 40
        ids = np.frombuffer(self.data, "<i8", docs, at).tolist()
        self.doc_ids = [None] * nulls + ids[nulls:]
        at += 8 * docs
        self.starts = np.frombuffer(self.data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        for _ in range(levels):
            n = int(np.frombuffer(self.data, "<u8", 1, at)[0])
            chunks = np.frombuffer(self.data, np.uint8, n, at + 8)
            at += 8 + n
            bits = np.frombuffer(self.data, np.uint8, -(-n // 8), at)
            at += len(bits)
            ranks = np.frombuffer(self.data, "<u4", -(-n // SPAN), at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.tokens

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // SPAN * SPAN // 8
            before = int(np.bitwise_count(bits[first : i >> 3]).sum()) + int(np.bitwise_count(bits[i >> 3] & ((1 << (i & 7)) - 1)))
            i, shift = int(ranks[i // SPAN]) + before, shift + 8
        return value

    def all(self) -> np.ndarray:
        out, places = np.zeros(self.tokens, np.uint32), np.arange(self.tokens, dtype=np.uint32)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[places] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            places = places[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write(docs: DataFrame, tokenizing, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every text, add ``end_id`` to each, write shards in ascending order of ids and return the manifest.

    Documents are dealt by ranges of ids (nulls first; repeated ids together, ordered by text), so that partition and
    sequence number order the shards. Null and empty texts have the end id alone; an empty table has no shards. Other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, ids, texts, held, own = TaskContext.get().partitionId(), 0, [], [], 0, tokenizing.value

        def flush() -> pa.RecordBatch:
            data = pack(ids, texts)
            store, path = _open(f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac")
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(path, compression=None) as file:
                file.write(data)
            row = (part, seq, f"{folder}/{path.rpartition('/')[2]}", len(ids), held, len(data))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "seq", "path", "n_docs", "n_tokens", "n_bytes"])

        for batch in (part for whole in common.slices(batches, ROWS) for part in together(whole, 1)):
            flat, sizes = own.many(batch.column(1).to_pylist())
            ends = np.cumsum(sizes)
            for i, a, b in zip(batch.column(0).to_pylist(), ends - sizes, ends, strict=True):
                tokens = np.append(flat[a:b], np.int32(end_id))
                ids.append(i)
                texts.append(tokens)
                held += len(tokens)
                if held >= shard_tokens:
                    yield flush()
                    seq, ids, texts, held = seq + 1, [], [], 0
                    common.give_back()
        if ids:
            yield flush()

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return common.written(ordered.mapInArrow(run, MANIFEST), "token-manifest")[0]


def with_base(manifest: DataFrame) -> DataFrame:
    """The manifest and ``base``: tokens in all shards before. Partitions are summed first, so that one task orders
    no more rows than there were partitions."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return manifest.withColumn("own", own).join(common.bounded(before), "part").withColumn("base", F.col("before") + F.col("own")).drop("before", "own")


def read(manifest: DataFrame) -> DataFrame:
    """One row for each document of the shards: doc_id, start, and its tokens."""
    spark = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = _open(path)
                with store.open_input_stream(at) as file:
                    shard = Shard(file.read())
                tokens = shard.all()
                for k in range(0, len(shard.doc_ids), 512):
                    ids, starts = shard.doc_ids[k : k + 512], shard.starts[k : k + 513]
                    lists = pa.ListArray.from_arrays(pa.array((starts - starts[0]).astype(np.int32)), pa.array(tokens[starts[0] : starts[-1]].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts[:-1] + base), lists], names=["doc_id", "start", "tokens"])

    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return with_base(manifest).repartition(parallel, "path").select("path", "base").mapInArrow(run, "doc_id long, start long, tokens array<int>")


def checks(manifest: DataFrame) -> DataFrame:
    """One row for each document of the shards: doc_id, start, n_tokens, and the unsigned CRC-32 of its ids as
    little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum([0, *lists.value_lengths().to_pylist()])
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(manifest).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the token files."""
    import public_tokenizers

    tokenizing = spark.sparkContext.broadcast(Tokenizing(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))
    return checks(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizing, common.fresh_path(spark, "token-files")))
