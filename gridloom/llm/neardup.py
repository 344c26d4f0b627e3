"""Near-duplicate documents by the Jaccard similarity of their five-word runs.

Documents (as sequences of words, see :func:`simhash.words`) are nodes, named by the XXH64 of their words. Each has the
64-bit SimHash of its runs; fingerprints that differ in ``RADIUS`` bits or fewer are linked by the segment tables of
:mod:`simhash`, and nodes whose fingerprints are linked, directly or not, are a bucket. A pair in a bucket is compared
exactly, as lines are in :mod:`linededup`. Fingerprints alone would lose pairs: at similarity 0.8 the cosine of two sets
of equal size is 0.89, so they differ in 10 bits on average and often in 16, and within 16 bits lie too many unrelated
documents. So the one-permutation MinHash over the same runs gives ``BANDS`` further keys to buckets; a pair of
similarity 0.8 shares one with probability 0.9998.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, linededup, simhash

SIZE, LEAST, BANDS = 5, 0.8, 16
#: Bits in which linked fingerprints may differ.
RADIUS = 3
#: Documents of a bucket that are compared at once.
MEMBERS = 48
#: Documents whose runs a worker holds at once.
CHUNK = 64


def runs(text: str | None) -> np.ndarray:
    """The sorted different hashes of a text's runs of five words (of the whole text if it has fewer)."""
    return np.unique(np.array(simhash.shingle_hashes(text, SIZE), np.uint64))


def node(text: str | None) -> int:
    """The signed 64-bit name of a text's words."""
    h = xxhash.xxh64_intdigest(b" ".join(simhash.words(text)))
    return h - (1 << 64) if h >> 63 else h


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """The band keys (signed) of sets of runs, one column for each band."""
    bins = BANDS * linededup.ROWS
    least = np.full((len(sets), bins), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for own, h in zip(least, sets, strict=True):
            np.minimum.at(own, ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64), h)
        return linededup.band_keys(linededup.filled(least))


def _similar(x: bytes, y: bytes) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= LEAST * (len(a) + len(b) - both) - 1e-9


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, CHUNK):
        good = [(a, b) for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) if _similar(x, y)]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in good], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _sets(bodies: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in bodies]


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, CHUNK):
        texts = batch.column(1).to_pylist()
        hashes = [simhash.shingle_hashes(t, SIZE) for t in texts]
        prints = np.array([simhash.fingerprint(h) for h in hashes], np.uint64).view(np.int64)
        own = bands([np.unique(np.array(h, np.uint64)) for h in hashes])
        columns = [batch.column(0), pa.array(list(map(node, texts)), pa.int64()), pa.array(prints), *(pa.array(own[:, b]) for b in range(BANDS))]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "node", "fp", *(f"b{b}" for b in range(BANDS))])


def _bodies(slim: DataFrame, pairs: DataFrame) -> DataFrame:
    shared = slim.sparkSession.sparkContext.broadcast(linededup._needed(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, CHUNK):
            texts = batch.column(1).to_pylist()
            names = np.array(list(map(node, texts)), np.int64)
            wanted = np.flatnonzero(shared.value[(names >> 6) & (linededup.FILTER_WORDS - 1)] >> (names & 63) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(names[wanted]), pa.array([runs(texts[i]).tobytes() for i in wanted], pa.binary())], names=["node", "body"])

    return slim.mapInArrow(run, "node long, body binary").dropDuplicates(["node"])


def near_prints(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """node and ``key``, one key for all nodes whose fingerprints ``fp`` links of ``radius`` or fewer bits lead to."""
    joined = common.components(simhash.links(nodes.select("fp").distinct(), radius)).select(F.col("node").alias("fp"), "component")
    return nodes.join(joined, "fp", "left").select("node", F.coalesce("component", "fp").alias("key"))


def groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the xxhash64 of a text) and ``component`` for every text of docs: texts that links of a similarity of
    ``LEAST`` or more lead to have the same one. Null, empty and white texts are alike."""
    slim = docs.select(F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    schema = "row long, node long, fp long, " + ", ".join(f"b{b} long" for b in range(BANDS))
    marked, _ = common.written(slim.mapInArrow(_banded, schema).dropDuplicates(["row"]), "neardup-rows")
    printed, _ = common.written(marked.drop("row").dropDuplicates(["node"]), "neardup-prints")
    keyed = near_prints(printed).withColumnRenamed("key", f"b{BANDS}")
    nodes, _ = common.written(printed.drop("fp").join(keyed, "node"), "neardup-nodes")
    links = linededup.linked(nodes, lambda pairs: _bodies(slim, pairs), _verify, _sets, LEAST, None, MEMBERS)
    joined = common.components(links)
    return marked.select("row", "node").join(joined, "node", "left").select("row", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each group of near duplicates: the one with the smallest id, a null id only where the whole
    group has none. Ties go to the least hash of the row."""
    return common.one_of_each(docs, groups(docs, text), doc_id, text)
