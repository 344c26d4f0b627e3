"""Fuzzy line dedup by MinHash.

Lines (normalised: lower case, ends stripped) are nodes, named by the XXH64 of their text; equal lines are one node.
A line's shingles are its runs of ``K`` characters (a shorter line is one shingle). One-permutation MinHash puts each
shingle's hash in one of ``BANDS * ROWS`` bins and keeps the least of each; empty bins borrow from their right.
A pair of Jaccard similarity 0.8 shares one of the bands with probability 0.995, one of 0.9 with 0.9999. In each
band's bucket the least node is compared with every other one by the exact Jaccard similarity of the shingle sets;
those that are not like it are then compared with every member of the bucket, in blocks and pairs of blocks. Links of
0.8 or more go to distributed union-find, and of each component the first line stays (least document id, then least
line number). Lines that are empty or white space are never removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K, ROWS, BANDS, LEAST = 8, 4, 10, 0.8
#: Code points hashed at once; a longer line is hashed alone.
BLOCK = 400_000
#: Documents whose lines a worker holds at once.
CHUNK = 128
#: Nodes of a bucket that are compared at once, all with all; larger buckets are dealt in blocks and pairs of blocks.
MEMBERS = 256
#: Characters of a line whose shingle set may be remembered, for as many lines as a group has.
SHORT = 1000
#: 64-bit words of the fixed-size filter (4 MB) that tells which lines' texts may be needed.
FILTER_WORDS = 1 << 19
#: Place of the bits that number the lines of a chunk.
_ROW = np.uint64(64 - (CHUNK - 1).bit_length())
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def normal(line: str) -> str:
    """A line as it is compared."""
    return line.strip().lower()


def node(line: str) -> int:
    """The signed 64-bit name of a normalised line."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """A polynomial hash of each run of k code points."""
    base, h, have = np.uint64(0x9E3779B97F4A7C15), points.astype(np.uint64) + np.uint64(1), 1
    power = base
    while have * 2 <= k:
        h = h[:-have] * power + h[have:]
        have, power = have * 2, power * power
    if have != k:
        raise ValueError("k is a power of two")
    return _mix(h)


def signatures(lines: list[str], bins: int = ROWS * BANDS) -> np.ndarray:
    """One row of bin minima for each normalised line."""
    out, at = np.empty((len(lines), bins), np.uint64), 0
    with np.errstate(over="ignore"):
        while at < len(lines):
            stop, size = at, 0
            while stop < len(lines) and (stop == at or size + len(lines[stop]) <= BLOCK):
                size += max(K, len(lines[stop]))
                stop += 1
            out[at:stop] = _signatures(lines[at:stop], bins)
            at = stop
    return out


def _hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle of the lines, and the place of its line."""
    padded = [x if len(x) >= K else x.ljust(K, "\0") for x in lines]
    if not padded:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    counts, starts = lengths - (K - 1), np.cumsum(lengths) - lengths
    whose = np.repeat(np.arange(len(lines)), counts)
    with np.errstate(over="ignore"):
        h = shingle_hashes(points)
    return h[np.arange(len(whose)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)], whose


def _signatures(lines: list[str], bins: int) -> np.ndarray:
    h, whose = _hashed(lines)
    cell = whose * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    least = np.full(len(lines) * bins, _FULL)
    np.minimum.at(least, cell, h)
    return filled(least.reshape(-1, bins))


def filled(least: np.ndarray) -> np.ndarray:
    """Bin minima, one row for each set; empty bins borrow from their right."""
    bins = least.shape[1]
    for _ in range(bins):
        empty = least == _FULL
        if not empty.any():
            break
        least = np.where(empty, np.where(np.roll(empty, -1, axis=1), _FULL, np.roll(least, -1, axis=1) + np.uint64(0x632BE59BD9B4E019)), least)
    return least


def bands(lines: list[str]) -> np.ndarray:
    """The band keys (signed) of normalised lines, one column for each band."""
    return band_keys(signatures(lines))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """The band keys (signed) of rows of bin minima, ``ROWS`` minima to a band."""
    count = sig.shape[1] // ROWS
    out = np.empty((len(sig), count), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(count):
            h = np.full(len(sig), b + 1, np.uint64)
            for r in range(ROWS):
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r])
            out[:, b] = h
    return out.view(np.int64)


def _set(line: str) -> frozenset[str]:
    return frozenset(line[i : i + K] for i in range(max(1, len(line) - K + 1)))


def _packed(line: str) -> np.ndarray | None:
    """The sorted different shingles of a line themselves, a byte a character; None if it has other characters or is
    shorter than a shingle."""
    if len(line) < K:
        return None
    try:
        data = line.encode("latin-1")
    except UnicodeEncodeError:
        return None
    own = np.sort(np.ndarray(len(data) - K + 1, np.uint64, data, strides=(1,)))
    return own[np.concatenate([[True], own[1:] != own[:-1]])]


_short_packed, _short_set = lru_cache(MEMBERS)(_packed), lru_cache(MEMBERS)(_set)


def jaccard(a: str, b: str) -> float:
    """Exact Jaccard similarity of two normalised lines' shingle sets."""
    x, y = ((_short_packed if len(t) <= SHORT else _packed)(t) for t in (a, b))
    if x is None or y is None:
        x, y = ((_short_set if len(t) <= SHORT else _set)(t) for t in (a, b))
        both = len(x & y)
    else:
        merged = np.sort(np.concatenate([x, y]))
        both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return both / (len(x) + len(y) - both)


def hashed_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted different shingle hashes of each normalised line."""
    padded = [x if len(x) >= K else x.ljust(K, "\0") for x in lines]
    with np.errstate(over="ignore"):
        h = shingle_hashes(np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)) if padded else np.zeros(0, np.uint64)
    out, at = [], 0
    for line in padded:
        own = np.sort(h[at : at + len(line) - K + 1])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        at += len(line)
    return out


def similar(a: list[str], b: list[str]) -> list[int]:
    """Which pairs of lines have a similarity of at least ``LEAST``. Equal hashes stand for equal shingles, so the
    hashes' similarity is never below the lines' own but by a collision inside one line; those that pass are
    compared exactly."""
    found = []
    for at in range(0, len(a), CHUNK):
        x, y = _marked(a[at : at + CHUNK]), _marked(b[at : at + CHUNK])
        both = np.sort(np.concatenate([x, y]))
        count = lambda marked, n=len(a[at : at + CHUNK]): np.bincount((marked >> _ROW).astype(np.int64), minlength=n)
        common_ = count(both[1:][both[1:] == both[:-1]])
        near = np.flatnonzero(common_ >= LEAST * (count(both) - common_) - 1) + at
        found += [i for i in near.tolist() if jaccard(a[i], b[i]) >= LEAST]
    return found


def _marked(lines: list[str]) -> np.ndarray:
    """The different shingle hashes of each of at most ``CHUNK`` lines, its place in the highest bits, sorted."""
    h, whose = _hashed(lines)
    with np.errstate(over="ignore"):
        h = np.sort(h & ((np.uint64(1) << _ROW) - np.uint64(1)) | whose.astype(np.uint64) << _ROW)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, list[str]]]:
    for i, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield i, row, (text or "").split("\n")


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, CHUNK):
        nodes, texts, docs, place = [], [], [], {}
        for i, _, lines in _rows(batch):
            for line in map(normal, lines):
                if line:
                    name = node(line)
                    if name not in place:
                        place[name] = len(texts)
                        texts.append(line)
                    nodes.append(name)
                    docs.append(i)
        own = bands(texts)[[place[x] for x in nodes]] if nodes else np.zeros((0, BANDS), np.int64)
        columns = [pa.array(nodes, pa.int64()), pa.array(docs, pa.int64()), *(pa.array(own[:, b]) for b in range(BANDS))]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "doc", *(f"b{b}" for b in range(BANDS))])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, CHUNK):
        out = [(i, row, k, node(x)) for i, row, lines in _rows(batch) for k, x in enumerate(map(normal, lines)) if x]
        columns = [*zip(*out, strict=True)] or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc", "row", "line", "node"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, CHUNK):
        a, b, x, y = (c.to_pylist() for c in batch.columns)
        good = similar(x, y)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], names=["a", "b"])


def _slim(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.col(doc_id).cast("long"), text).alias("row"), F.col(text).alias("text"))


def _keys(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode(F.array(*(c for c in nodes.columns if c[0] == "b"))).alias("key"), "node")


def buckets(nodes: DataFrame) -> DataFrame:
    """key, ``low``, ``high`` and ``n`` of each bucket of two or more nodes."""
    found = _keys(nodes).groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low < high")
    return common.written(found, "line-buckets")[0]


def candidates(nodes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of different nodes: in each bucket of each band, the least node and every other one."""
    known = buckets(nodes) if known is None else known
    pairs = known.select(F.col("high").alias("a"), F.col("low").alias("b"))
    full = common.bounded(known.where("n > 2").select("key", "low", "high"))
    more = _keys(nodes).join(full, "key").where("node <> low AND node <> high").select(F.col("node").alias("a"), F.col("low").alias("b"))
    return common.written(pairs.unionByName(more).distinct(), "line-pairs")[0]


def unsettled(nodes: DataFrame, known: DataFrame, stars: DataFrame, block: int = MEMBERS) -> DataFrame:
    """Who is still to be compared: groups ``g`` of nodes, ``split`` (only nodes of unequal ``side`` are compared) and
    ``settled`` (linked to the least of its bucket). stars: the links (a, b) of :func:`candidates` that held.

    The members of a bucket that are not like its least one meet each other and all others there, in blocks and pairs
    of blocks of about ``block`` nodes; those that are like it are linked already and do not meet each other. Buckets of
    the same members (in several bands; told by 128 bits of hashes) are compared once."""
    full = common.bounded(known.where("n > 2").select("key", "low"))
    met = _keys(nodes).join(full, "key").join(stars.select(F.col("a").alias("node"), F.col("b").alias("low"), F.lit(True).alias("_like")), ["node", "low"], "left")
    members, _ = common.written(met.select("key", "node", F.coalesce("_like", F.col("node") == F.col("low")).alias("settled")), "line-members")
    own = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]
    sizes = members.groupBy("key").agg(F.count_if("settled").alias("s"), F.count_if(~F.col("settled")).alias("r"), *own).where("r > 0")
    sizes = sizes.groupBy("s", "r", "x0", "x1").agg(F.min("key").alias("key"))
    parts = lambda c: F.ceil(F.col(c) / block).cast("int").alias(f"{c}_parts")
    sized, _ = common.written(sizes.select("key", parts("s"), parts("r")), "line-sizes")
    dealt = members.join(common.bounded(sized), "key")
    spot = lambda c: F.pmod(F.xxhash64("node"), c).cast("int")
    own = F.when(F.col("settled"), F.col("r_parts") + spot("s_parts")).otherwise(spot("r_parts"))
    last = F.when(F.col("settled"), F.col("r_parts")).otherwise(F.col("r_parts") + F.col("s_parts")) - 1
    both = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return both.select(F.xxhash64("key", low, high).alias("g"), (low != high).alias("split"), (F.col("own") == high).alias("side"), "settled", "node")


def shared_counts(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many members each two of the sets (arrays without repeats) have in common."""
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, row = every[order], np.repeat(np.arange(len(sets)), list(map(len, sets)))[order]
    again = np.concatenate([[False], every[1:] == every[:-1]])[: len(every)]
    met = again | np.append(again[1:], False)[: len(every)]
    row, place = row[met], np.cumsum(~again[met]) - 1
    out = np.zeros((len(sets), len(sets)), np.float64)
    width = int(place[-1]) + 1 if len(place) else 0
    columns = min(columns, max(width, 1))
    for at in range(0, width, columns):
        own = slice(*np.searchsorted(place, [at, at + columns]))
        has = np.zeros((len(sets), columns), np.float32)
        has[row[own], place[own] - at] = 1
        out += has @ has.T
    return out


def group_links(nodes: list[int], bodies: list, settled: list[bool], side: list[bool] | None, sets: list[np.ndarray], least: float, exact: Callable | None) -> list[tuple[int, int]]:
    """Links that connect all pairs of a group's nodes of similarity ``least`` or more: all pairs, or with sides those
    across. Settled nodes are connected with each other from the start. ``exact`` compares two bodies again."""
    both, sizes = shared_counts(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    x, y = np.triu_indices(len(sets), 1)
    n = both[x, y]
    near = n >= least * (sizes[x] + sizes[y] - n) - (1 if exact else 1e-9)
    flags = np.array(settled)
    near &= ~(flags[x] & flags[y])
    if side is not None:
        near &= np.array(side)[x] != np.array(side)[y]
    head, found = [*range(len(nodes))], []

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for i in np.flatnonzero(flags)[1:]:
        head[find(int(i))] = find(int(np.flatnonzero(flags)[0]))
    for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
        if (p := find(i)) != (q := find(j)) and (exact is None or exact(bodies[i], bodies[j]) >= least):
            head[p] = q
            found.append((nodes[i], nodes[j]))
    return found


def compared(sets: Callable, least: float, exact: Callable | None) -> Callable:
    """A function over batches of g, split, side, settled, node, body, sorted by g: the links of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found = [], []

        def close() -> None:
            if len(rows) > 1:
                _, split, side, settled, nodes, bodies = zip(*rows, strict=True)
                found.extend(group_links(nodes, bodies, settled, side if split[0] else None, sets(bodies), least, exact))
            rows.clear()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found.clear()
            return made

        for batch in batches:
            for part in common.slices([batch], MEMBERS):
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if rows and rows[0][0] != row[0]:
                        close()
                    rows.append(row)
            yield out()
        close()
        yield out()

    return run


def linked(nodes: DataFrame, bodies_of: Callable[[DataFrame], DataFrame], verify: Callable, sets: Callable, least: float, exact: Callable | None, block: int = MEMBERS) -> DataFrame:
    """Links (a, b) that connect all pairs of nodes of similarity ``least`` or more that share a bucket.

    nodes: node and its band keys ``b0``... ``bodies_of`` gives node and ``body`` of all nodes in the pairs it gets;
    ``verify`` works on batches of a, b and their bodies."""
    known = buckets(nodes)
    pairs = candidates(nodes, known)
    bodies, _ = common.written(bodies_of(pairs), "line-texts")
    first = pairs.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), "a")
    both = first.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
    stars, _ = common.written(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "line-stars")
    rest = unsettled(nodes, known, stars, block).join(bodies, "node").select("g", "split", "side", "settled", "node", "body")
    more = rest.repartition("g").sortWithinPartitions("g").mapInArrow(compared(sets, least, exact), "a long, b long")
    return stars.unionByName(common.written(more, "line-more")[0])


def _word(column: str) -> F.Column:
    return F.shiftrightunsigned(column, 6).bitwiseAND(FILTER_WORDS - 1)


def _needed(pairs: DataFrame) -> np.ndarray:
    """A filter of fixed size with one bit for each node of the pairs; it may let others pass."""
    both = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    words = both.select(_word("node").alias("w"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    out = np.zeros(FILTER_WORDS, np.int64)
    found = words.toPandas()  # FILTER_WORDS rows at most
    out[found["w"].to_numpy(np.int64)] = found["m"].to_numpy(np.int64)
    return out


def texts_of(slim: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and its normalised text for every node of the pairs, and for some others."""
    shared = slim.sparkSession.sparkContext.broadcast(_needed(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in common.slices(batches, CHUNK):
            lines = [x for _, _, own in _rows(batch) for x in map(normal, own) if x]
            names = np.fromiter(map(node, lines), np.int64, len(lines))
            wanted = bits[(names >> 6) & (FILTER_WORDS - 1)] >> (names & 63) & 1
            found = {int(names[i]): lines[i] for i in np.flatnonzero(wanted) if int(names[i]) not in seen}
            if len(seen) < 100_000:  # only so many are remembered; a line met again is sent again
                seen |= found.keys()
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.string())], names=["node", "line"])

    return slim.mapInArrow(run, "node long, line string").dropDuplicates(["node"])


def links(slim: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of nodes that connect all whose shingle sets have a Jaccard similarity of at least ``LEAST``."""
    keyed = nodes.select("node", *(f"b{b}" for b in range(BANDS)))
    return linked(keyed, lambda pairs: texts_of(slim, pairs).withColumnRenamed("line", "body"), _verify, hashed_sets, LEAST, jaccard)


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row (a hash of id and text) and ``removed``, the sorted numbers (from 0) of the lines that go."""
    slim = _slim(docs, doc_id, text)
    schema = "node long, doc long, " + ", ".join(f"b{b} long" for b in range(BANDS))
    grouped = slim.mapInArrow(_banded, schema).groupBy("node").agg(F.count("*").alias("n"), F.min("doc").alias("doc"), *(F.min(f"b{b}").alias(f"b{b}") for b in range(BANDS)))
    nodes, _ = common.written(grouped, "lines")
    joined = common.components(links(slim, nodes))
    linked = joined.join(nodes.select("node", "doc"), "node")
    least = linked.groupBy("component").agg(F.min("doc").alias("first"))
    named = linked.select("node", "component").join(least, "component")
    alone = nodes.where("n > 1").join(joined, "node", "left_anti").select("node", F.col("node").alias("component"), F.col("doc").alias("first"))
    known, _ = common.written(named.select("node", "component", "first").unionByName(alone), "line-classes")
    seen, _ = common.written(slim.mapInArrow(_occurrences, "doc long, row long, line int, node long").join(known, "node"), "line-copies")
    own = seen.where(F.col("doc").eqNullSafe(F.col("first")))
    row = own.groupBy("component").agg(F.min("row").alias("row"))
    stays = own.join(row, ["component", "row"]).groupBy("component", "row").agg(F.min("line").alias("stay"))
    marked = seen.join(stays.withColumnRenamed("row", "stay_row"), "component")
    gone = marked.where(~((F.col("row") == F.col("stay_row")) & (F.col("line") == F.col("stay"))))
    return gone.groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def without(lines: F.Column, removed: F.Column) -> F.Column:
    """An array without the elements at the places (from 0, ascending) in another one: the slices between neighbouring
    places, so that the work grows with the two lengths and not with their product."""

    def slices(both: F.Column) -> F.Column:
        def between(i: F.Column) -> F.Column:
            before = F.when(i == 0, -1).otherwise(F.get(both["removed"], i - 1))
            after = F.when(i == F.size(both["removed"]), F.size(both["lines"])).otherwise(F.get(both["removed"], i))
            return F.slice(both["lines"], before + 2, after - before - 1)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(both["removed"])), between))

    # inside the lambda the struct is a value, so that the text is split once
    return F.get(F.transform(F.array(F.struct(lines.alias("lines"), removed.alias("removed"))), slices), 0)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with the removed lines taken out of their text, and two columns: ``_n_lines`` and ``_removed``
    (the sorted numbers of removed lines, empty if none).

    Every row stays, even one that loses all its lines (its text is then empty). Null texts stay null and have no
    lines. Rows with equal id and text count as one row and get the same result; a null id comes last. An empty
    table gives an empty result. Texts of any length are read whole. Ids are integers, or what casts to them. A column
    of docs named as a new one gives way to it; others stay.
    """
    key, cut = "_row_of_line_dedup", "_cut_of_line_dedup"
    docs = docs.drop("_n_lines", "_removed")
    gone = removals(docs, doc_id, text).select(F.col("row").alias(key), F.col("removed").alias(cut))
    whole = docs.withColumn(key, F.xxhash64(F.col(doc_id).cast("long"), text)).join(gone, key, "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_join(without(lines, F.col(cut)), "\n")
    return whole.withColumns({
        text: F.when(F.col(cut).isNull(), F.col(text)).otherwise(kept),
        "_n_lines": F.coalesce(F.size(lines), F.lit(0)),
        "_removed": F.coalesce(cut, F.array().cast("array<int>")),
    }).drop(key, cut)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, which of them go, and a digest of the text that stays."""
    done = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select(
        "doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.size("_removed").cast("long").alias("n_removed"), F.col("_removed").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
