"""Removal of long repeated byte strings by backward extension on a positional Burrows-Wheeler transform.

Anchors. The anchor of a window of ``LENGTH`` bytes is the place in it where the hash of ``K`` bytes is least
(leftmost of equals). Equal windows have equal anchors at the same offset, so windows need comparing only inside a
group of equal anchor hashes. A context is a run of windows of one document with one anchor; equal contexts of a group
are one, with a count. All windows of a context that occurs twice are repeated.

Groups with several contexts. Contexts are laid out aligned at the anchor. Columns are taken from right to left: the
contexts of every group of a block, sorted by what stands at and after the column, form the intervals of a positional
Burrows-Wheeler transform, and one step extends all intervals backwards by one byte at once (breadth first): a stable
sort by the byte splits them, and the common prefix of neighbours grows by one or is cut by the least value between
them. Values matter up to ``LENGTH`` alone, the bound of a context. A window is repeated if its common prefix with a
neighbour is at least that long.

Groups of more than ``MAX_GROUP`` contexts are not put in one task: their windows' hashes are counted in a grouped
aggregation instead, which has the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, K = 400, 64
MAX_GROUP = 2_000
#: Window starts that are looked at together in a long text, and contexts laid out together.
SEGMENT, BLOCK = 1 << 22, 8_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)
_PAD = 256


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash (modulo 2^64, mixed) of every run of ``size`` bytes."""
    with np.errstate(over="ignore"):
        power, h, have, out, got = _BASE, data.astype(np.uint64) + np.uint64(1), 1, None, 0
        while True:
            if size & have:
                # runs of ``got`` bytes, followed by ``have`` more
                out = h if out is None else out[: len(h) - got] * power + h[got:] if len(h) > got else h[:0]
                got += have
            if have * 2 > size:
                break
            h = h[:-have] * power + h[have:] if len(h) > have else h[:0]
            have, power = have * 2, power * power
        out = out[: max(0, len(data) - size + 1)]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(29))


def window_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` neighbours."""
    n = len(h) - width + 1
    rows = -(-len(h) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: bytes, length: int = LENGTH, k: int = K) -> Iterator[tuple[int, int, int, int]]:
    """(start, windows, offset of the anchor, anchor hash) of every run of windows with one anchor."""
    width = length - k + 1
    for at in range(0, len(data) - length + 1, SEGMENT):
        part = np.frombuffer(data, np.uint8)[at : at + SEGMENT + length - 1]
        h = hashes(part, k)
        places = h & ~_PLACE | np.arange(len(h), dtype=np.uint64)
        anchor = (window_least(places, width) & _PLACE).astype(np.int64)
        starts = np.flatnonzero(np.diff(anchor, prepend=-1))
        counts = np.diff(starts, append=len(anchor))
        found = anchor[starts]
        yield from zip((starts + at).tolist(), counts.tolist(), (found - starts).tolist(), h[found].view(np.int64).tolist(), strict=True)


def _context_name(data: bytes, start: int, n: int, offset: int, length: int) -> int:
    return _signed(xxhash.xxh64_intdigest(data[start : start + n - 1 + length], offset))


def _listed(length: int, k: int):
    names = ["h", "ctx", "row", "start", "n", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                if len(data) >= length:
                    out += [(h, _context_name(data, s, n, o, length), row, s, n, o) for s, n, o, h in contexts(data, length, k)]
                if len(out) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return run


def _fetched(length: int):
    names = ["h", "ctx", "offset", "n", "big", "body"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, places in zip(*(batch.column(i) for i in (0, 1)), strict=True):
                data, seen = (text.as_py() or "").encode(), set()
                out = []
                for p in places.as_py():
                    if (p["h"], p["ctx"]) not in seen:
                        seen.add((p["h"], p["ctx"]))
                        out.append((p["h"], p["ctx"], p["offset"], p["n"], p["big"], data[p["start"] : p["start"] + p["n"] - 1 + length]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def extend(groups: list[list[tuple[int, int, bytes]]], length: int = LENGTH) -> list[list[np.ndarray]]:
    """For each context (offset of the anchor, windows, bytes) of each group: which of its windows also start in
    another context of the group."""
    flat = [c for g in groups for c in g]
    sizes = np.array([len(g) for g in groups])
    left, right = max(o for o, _, _ in flat), max(len(b) - o for o, _, b in flat)
    table = np.full((left + right, len(flat)), _PAD, np.uint16)
    for i, (o, _, b) in enumerate(flat):
        table[left - o : left - o + len(b), i] = np.frombuffer(b, np.uint8)
    group = np.repeat(np.arange(len(groups)), sizes) * 512
    head = np.zeros(len(flat) + 1, bool)
    head[np.concatenate([[0], np.cumsum(sizes)])] = True  # where groups begin, in any order of their contexts
    order = np.arange(len(flat))
    differ = np.full(len(flat) + 1, left + right, np.int64)  # the first column in which neighbours differ
    differ[head] = -1
    repeated = np.zeros((left + right, len(flat)), bool)
    for x in range(left + right - 1, -1, -1):
        byte = table[x, order].astype(np.int64)
        unlike = byte[1:] != byte[:-1]
        if (unlike & ~head[1:-1]).any():
            turn = np.argsort(group + byte, kind="stable")
            same = (byte[turn[1:]] == byte[turn[:-1]]) & ~head[1:-1]
            a, b = turn[:-1][same], turn[1:][same]
            after = np.full(len(flat) + 1, x, np.int64)
            values = differ[b].copy()
            far = b > a + 1
            if far.any():
                ends = np.stack([a[far] + 1, b[far] + 1], axis=1).ravel()
                values[far] = np.minimum.reduceat(differ, ends)[::2]
            after[1:-1][same] = values
            after[head] = -1
            differ, order = after, order[turn]
        if x + length <= left + right:
            long = differ - x >= length
            repeated[x, order] = long[:-1] | long[1:]
    out, at = [], 0
    for g in groups:
        out.append([repeated[left - o : left - o + n, at + i] for i, (o, n, _) in enumerate(g)])
        at += len(g)
    return out


def spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """The runs (first, end) of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_SPAN_TYPE = "array<struct<a:long,b:long>>"


def _extended(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple]] = []
        held = 0

        def out() -> pa.RecordBatch:
            real = [g for g in groups if len(g) > 1]
            flags = extend([[c[2:] for c in g] for g in real], length) if real else []
            rows = [(c[0], c[1], [{"a": a, "b": b} for a, b in spans(f)]) for g, fs in zip(real, flags, strict=True) for c, f in zip(g, fs, strict=True) if f.any()]
            columns = [*zip(*rows, strict=True)] or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), _SPANS), strict=True)], names=["h", "ctx", "spans"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not groups or groups[-1][0][0] != row[0]:
                    if held >= BLOCK:
                        yield out()
                        groups, held = [], 0
                    groups.append([])
                groups[-1].append(row)
                held += 1
        yield out()

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, ctx, offset, _, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = hashes(np.frombuffer(body, np.uint8), length).view(np.int64)
                at = np.arange(len(w))
                columns = [np.full(len(w), h), np.full(len(w), ctx), at, at - offset, w]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h", "ctx", "at", "place", "w"])

    return run


def repeated(slim: DataFrame, listed: DataFrame, length: int = LENGTH) -> DataFrame:
    """h, ctx and the spans of repeated windows, for contexts that have any. slim: row, text; listed: all contexts."""
    once = listed.groupBy("h", "ctx").agg(F.count("*").alias("c"), F.first("row").alias("row"), F.first("start").alias("start"), F.first("n").alias("n"), F.first("offset").alias("offset"))
    once, _ = common.written(once, "substring-contexts")
    groups = once.groupBy("h").agg(F.count("*").alias("different")).where("different > 1")
    whole = once.where("c > 1").select("h", "ctx", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))).alias("spans"))
    wanted = once.join(groups, "h").select("row", F.struct("h", "ctx", "start", "n", "offset", (F.col("different") > MAX_GROUP).alias("big")).alias("p"))
    places = wanted.groupBy("row").agg(F.collect_list("p").alias("places"))
    bodies = slim.dropDuplicates(["row"]).join(places, "row").select("text", "places").mapInArrow(_fetched(length), "h long, ctx long, offset long, n long, big boolean, body binary")
    bodies, _ = common.written(bodies, "substring-bodies")
    small = bodies.where("NOT big").select("h", "ctx", "offset", "n", "body").repartition("h").sortWithinPartitions("h")
    found = small.mapInArrow(_extended(length), f"h long, ctx long, spans {_SPAN_TYPE}")
    each = bodies.where("big").select("h", "ctx", "offset", "n", "body").mapInArrow(_windows(length), "h long, ctx long, at long, place long, w long")
    twice = each.groupBy("h", "place", "w").agg(F.count("*").alias("times")).where("times > 1")
    starts = each.join(twice, ["h", "place", "w"]).groupBy("h", "ctx").agg(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("spans"))
    partly = found.unionByName(starts).join(whole.select("h", "ctx"), ["h", "ctx"], "left_anti")
    return common.written(whole.unionByName(partly), "substring-repeats")[0]


def _cut(kept_names: list[str], text: str, schema_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, gone, runs, bodies = [], [], [], []
                for body, cuts in zip(batch.column(schema_names.index(text)), batch.column(schema_names.index("_cuts")), strict=True):
                    data, cuts = (body.as_py() or "").encode(), cuts.as_py() or []
                    merged: list[list[int]] = []
                    for c in sorted((c["a"], c["b"]) for c in cuts):
                        if merged and c[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], c[1])
                        else:
                            merged.append([*c])
                    ends = [0, *(x for m in merged for x in m), len(data)]
                    sizes.append(len(data))
                    gone.append(sum(b - a for a, b in merged))
                    runs.append([{"a": a, "b": b} for a, b in merged])
                    bodies.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                new = [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, _SPANS), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(batch.column(schema_names.index(c)) for c in kept_names), *new], names=[*kept_names, "n_bytes", "n_removed", "removed", "kept"])

    return run


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """One row for each row of docs: the id, n_bytes, n_removed, ``removed`` (the maximal removed runs as half-open
    byte spans) and ``kept`` (the other bytes).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the table, the same
    document included; strings are judged on the input. Null and shorter texts lose nothing; a null id is a value like
    others; rows that repeat are different documents, so each loses what the other has. A removed run may begin or end
    inside a character, so ``kept`` is bytes. An empty table gives an empty result. Other columns are not read.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("row"))
    listed, _ = common.written(slim.select("row", "text").mapInArrow(_listed(length, k), "h long, ctx long, row long, start long, n long, offset long"), "substring-anchors")
    found = repeated(slim.select("row", "text"), listed, length)
    each = listed.join(found, ["h", "ctx"]).select("row", "start", F.explode("spans").alias("s"))
    cuts = each.groupBy("row").agg(F.collect_set(F.struct((F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b") + length - 1).alias("b"))).alias("_cuts"))
    joined = slim.join(cuts, "row", "left").select("doc_id", "text", "_cuts")
    kind = docs.schema[doc_id].dataType.simpleString()
    return joined.mapInArrow(_cut(["doc_id"], "text", joined.columns), f"doc_id {kind}, n_bytes long, n_removed long, removed {_SPAN_TYPE}, kept binary")


def digest(data: bytes) -> str:
    """What the query reports of kept bytes."""
    return hashlib.sha256(data).hexdigest()


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, how many go in how many runs, and a digest of those that stay."""
    done = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
