"""SimHash near-dedup by multi-index hashing.

A fingerprint is cut into segments, each with a table of its own. With m segments, two fingerprints within r bits are
within r // m bits in one of the first r % m + 1 segments, or nearer in one of the others; so balls of these radii are
enumerated inside each segment, the table's matches are fetched, and whole distances are verified. Of two values that
differ only the greater probes, which halves the balls and loses no pair.

A key that many fingerprints share is cut again: those within r bits agree in one of r + 1 pieces of their other bits.
So a group that one task compares has few members, or fingerprints that agree in all but ten bits. Of a group only
links that connect it are emitted, fewer than it has members.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SEED = 42
SEGMENTS = 2
BITS = 64
#: Members of a key beyond which it is cut again, and the free bits at which it never is.
CROWD, FREE = 2_048, 10
#: Rows that cuts may make of one row; keys that are crowded still are compared in blocks.
COPIES = 64
#: Fingerprints that are compared at once.
SIDE = 2_048


def words(text: str | None) -> list[bytes]:
    """Words of a text as bytes: A-Z lowered, cut at space and the control characters 09 to 0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None, size: int = 3) -> list[int]:
    """XXH64 of each run of ``size`` words, repeats included; of the whole sequence if it is shorter; none if empty."""
    found = words(text)
    if not found:
        return []
    digest = xxhash.xxh64_intdigest
    if len(found) < size:
        return [digest(b" ".join(found), SEED)]
    return [digest(x, SEED) for x in map(b" ".join, zip(*(found[i:] for i in range(size)), strict=False))]


def fingerprint(hashes: list[int], chunk: int = 65_536) -> np.uint64:
    """The 64-bit fingerprint of a text's shingle hashes; a bit is one if set in over half of them, zero if none."""
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), chunk):
        block = np.array(hashes[at : at + chunk], dtype="<u8").view(np.uint8)
        counts += np.unpackbits(block.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return weights[2 * counts > len(hashes)].sum(dtype=np.uint64)


def fingerprints(texts: list[str | None], size: int = 3, chunk: int = 65_536) -> np.ndarray:
    """The fingerprint of each text as unsigned integers."""
    return np.array([fingerprint(shingle_hashes(t, size), chunk) for t in texts], dtype=np.uint64)


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "fp", size: int = 3) -> DataFrame:
    """The columns ``keep`` of docs and a long column with the fingerprint (its bits as a signed number)."""
    keep = docs.columns if keep is None else keep
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.LongType(), False)])
    columns = list(dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = fingerprints(batch.column(columns.index(text)).to_pylist(), size)
            kept = [batch.column(columns.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found.view(np.int64))], names=[*keep, name])

    return docs.select(*columns).mapInArrow(run, schema)


def segments(m: int) -> list[list[int]]:
    """The bits of each of m segments of a fingerprint."""
    ends = [BITS * i // m for i in range(m + 1)]
    return [list(range(a, b)) for a, b in zip(ends, ends[1:], strict=False)]


def _mask(bits: Iterable[int]) -> int:
    whole = sum(1 << b for b in bits)
    return whole - (1 << BITS) if whole >> (BITS - 1) else whole


def tables(distinct: DataFrame, radius: int = 2, m: int = SEGMENTS, probes: bool = True) -> DataFrame:
    """The rows of all tables, and of all probes if these are asked for: ``mask`` (the segment's bits), ``at`` (the value
    that is looked up in it, with the other bits as in ``fp``), ``probe`` (false for the table's own row), ``fp``."""
    every = []
    for i, bits in enumerate(segments(m)):
        ball = radius // m - (i > radius % m)
        if ball >= 0:
            every += [(_mask(bits), _mask(c), n > 0) for n in range(ball + 1 if probes else 1) for c in combinations(bits, n)]
    each = F.explode(F.array(*(F.struct(F.lit(a).cast("long").alias("mask"), F.lit(x).cast("long").alias("flip"), F.lit(p).alias("probe")) for a, x, p in every))).alias("k")
    at = F.col("fp").bitwiseXOR(F.col("k.flip"))
    dealt = distinct.select("fp", each).select("k.mask", at.alias("at"), "k.probe", "fp")
    part = lambda c: F.shiftrightunsigned(F.col(c).bitwiseAND(F.col("mask")), 1)  # noqa: E731  unsigned order but for the last bit
    last = lambda c: F.col(c).bitwiseAND(F.col("mask")).bitwiseAND(F.lit(1))
    return dealt.where(~F.col("probe") | (part("at") < part("fp")) | ((part("at") == part("fp")) & (last("at") < last("fp"))))


def _pieces(mask: int, radius: int) -> list[int]:
    """The mask with each of radius + 1 pieces of its other bits added."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    ends = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [_mask(b for b in range(BITS) if mask >> b & 1 or b in free[x:y]) for x, y in zip(ends, ends[1:], strict=False)]


def dealt(distinct: DataFrame, radius: int, m: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """The rows of :func:`tables` with ``key``; keys of more than ``crowd`` members are cut until they have fewer,
    ``FREE`` bits are left or another cut would make over ``COPIES`` rows of one. Each cut makes radius + 1 rows of one
    in crowded keys only."""
    key = lambda df: df.withColumn("key", F.col("at").bitwiseAND(F.col("mask")))
    now, own, done, masks = key(tables(distinct, radius, m)), key(tables(distinct, radius, m, False)), None, [_mask(bits) for bits in segments(m)]
    copies = 1
    while True:
        copies *= radius + 1
        members = own.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
        free = [m for m in masks if copies <= COPIES and BITS - (m % (1 << BITS)).bit_count() > FREE]
        if not free:
            return now if done is None else done.unionByName(now)
        crowded, _ = common.written(members.where(F.col("mask").isin(free)).select("mask", "key"), "simhash-crowded")
        if crowded.isEmpty():
            return now if done is None else done.unionByName(now)
        hint = common.bounded(crowded)
        rest = now.join(hint, ["mask", "key"], "left_anti")
        done = rest if done is None else done.unionByName(rest)
        finer = [p for x in free for p in _pieces(x % (1 << BITS), radius)]
        cut = F.create_map(*(x for m in free for x in (F.lit(m).cast("long"), F.array(*(F.lit(p).cast("long") for p in _pieces(m % (1 << BITS), radius))))))
        again = now.join(hint, ["mask", "key"], "left_semi").select(F.explode(cut[F.col("mask")]).alias("mask"), "at", "probe", "fp")
        masks = list(dict.fromkeys(finer))
        now = key(common.written(again if len(masks) == len(finer) else again.distinct(), "simhash-cut")[0])
        own = now.where(~F.col("probe"))


def group_links(fp: np.ndarray, probe: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of at most ``radius`` bits that connect all linked members and probes of one key: member with member, probe
    with member. fp: unsigned."""
    head = list(range(len(fp)))

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    found, own, every = [], np.flatnonzero(~probe), np.arange(len(fp))
    for x in range(0, len(own), SIDE):
        for y in range(0, len(every), SIDE):
            a, b = own[x : x + SIDE], every[y : y + SIDE]
            near = np.bitwise_count(fp[a][:, None] ^ fp[b][None, :]) <= radius
            for i, j in zip(*np.nonzero(near), strict=True):
                if (p := find(int(a[i]))) != (q := find(int(b[j]))):
                    head[p] = q
                    found.append((int(a[i]), int(b[j])))
    return found


def _compared(radius: int):
    """Links of each key in batches of mask, key, probe, fp, sorted by mask and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4

        def out(last: bool) -> pa.RecordBatch:
            nonlocal held
            mask, key, probe, fp = held
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            ends = np.concatenate([[0], cuts, [len(mask)] if last else []]).astype(np.int64)
            sizes, links = np.diff(ends), []
            members = np.add.reduceat(1 - probe, ends[:-1]) if len(sizes) and len(mask) else sizes * 0
            for k in np.flatnonzero((sizes > 1) & (members > 0)):
                a, b = ends[k], ends[k + 1]
                links += [(fp[a + i], fp[a + j]) for i, j in group_links(fp[a:b].view(np.uint64), probe[a:b] > 0, radius)]
            held = [x[ends[-1] :] for x in held]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            new = [batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(4)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            yield out(False)
        yield out(True)

    return run


def links(distinct: DataFrame, radius: int = 2, m: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between the fingerprints ``fp`` of a frame without repeats, enough to connect all that links of at
    most ``radius`` bits lead to, by ``m`` segment tables."""
    rows = dealt(distinct, radius, m, crowd).select("mask", "key", F.col("probe").cast("long").alias("probe"), "fp")
    met = rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return met.mapInArrow(_compared(radius), "a long, b long").distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """One row for each row of docs: the id, its fingerprint ``fp`` and ``component_id``, the smallest id that links
    of two or fewer differing bits lead to.

    Null and empty texts, and texts of white space alone, have fingerprint zero and link like any other. A null id
    takes part but never names a component unless all ids in it are null. Repeated rows give repeated rows. An empty
    table gives an empty result; other columns do not matter.
    """
    marked, _ = common.written(with_fingerprint(docs, text, [doc_id], "fp", size), "simhash")
    heads, _ = common.written(marked.groupBy("fp").agg(F.min(doc_id).alias("head")), "simhash-heads")
    joined = common.components(links(heads.select("fp")))
    lowest = joined.join(heads, joined.node == heads.fp).groupBy("component").agg(F.min("head").alias("least"))
    named = joined.join(lowest, "component").select(F.col("node").alias("fp"), "least")
    final = heads.join(named, "fp", "left").select("fp", F.coalesce("least", "head").alias("component_id"))
    return marked.join(final, "fp").select(doc_id, "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint (16 hex digits) and component."""
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
