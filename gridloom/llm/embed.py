"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised; each of ``TABLES`` tables has ``WIDTH`` hashes floor((g . x + b) / W), g normal and b uniform.
Two unit vectors of cosine 0.93 (distance 0.374) share one hash with probability 0.85, so all of a table's with 0.27
and at least one table's with 0.9995; larger cosines do better. The vectors of a bucket are compared by exact cosine in
double precision; a pair that meets in several tables counts in the first. Equal vectors are one node with a number
of copies. Buckets beyond ``BLOCK`` nodes are dealt into blocks, and each pair of blocks is a group of its own; a
group gives, for each of its nodes, the number of new links and the least node that links lead to inside the group,
so that what is shuffled grows with the rows and not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TABLES, WIDTH, W, SEED = 24, 8, 2.0, 20_240_101
BLOCK, LEAST = 512, 0.93


def _projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, TABLES * WIDTH)), rng.uniform(0, W, TABLES * WIDTH)


def unit(vector: list | None) -> np.ndarray | None:
    """The vector divided by its length; None if it is null, empty, zero or has a null or non-finite component."""
    if not vector or any(x is None for x in vector):
        return None
    x = np.array(vector, np.float64)
    if not np.isfinite(x).all():
        return None
    largest = np.abs(x).max()
    if largest == 0:
        return None
    x = x / largest  # squares neither overflow nor vanish
    return x / np.sqrt(x @ x)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def table_keys(units: np.ndarray, projections: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The hashes of unit vectors, one row of TABLES x WIDTH integers for each."""
    return np.floor((units @ projections[0] + projections[1]) / W).astype(np.int64).reshape(len(units), TABLES, WIDTH)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made: dict[int, tuple] = {}
    for batch in batches:
        ids, vectors, labels = (c.to_pylist() for c in batch.columns)
        nodes, packed, keys = [], [], []
        for vector, label in zip(vectors, labels, strict=True):
            x = None if label is None else unit(vector)
            if x is None:
                nodes.append(None), packed.append(None), keys.append(None)
                continue
            body = x.tobytes()
            nodes.append(_signed(xxhash.xxh64_intdigest(body, label & 0xFFFFFFFF)))
            packed.append(body)
            if len(x) not in made:
                made[len(x)] = _projections(len(x))
            cells = table_keys(x[None], made[len(x)])[0]
            keys.append([_signed(xxhash.xxh64_intdigest(np.array([label, len(x), t, *cells[t]], np.int64).tobytes())) for t in range(TABLES)])
        columns = [pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(labels, pa.int64()), pa.array(packed, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "label", "vector", "keys"])


def _linked(mask: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The least node that each row (and column) of a link matrix leads to inside it."""
    a, b = left.copy(), (left if right is None else right).copy()
    top = np.iinfo(np.int64).max
    while True:
        na = np.minimum(a, np.where(mask, b[None, :], top).min(axis=1))
        nb = na if right is None else np.minimum(b, np.where(mask, na[:, None], top).min(axis=0))
        if (na == a).all() and (nb == b).all():
            return a, b
        a, b = na, nb


def _group(rows: list[tuple], least: float) -> Iterator[tuple[int, int, int]]:
    """(node, new links, least node reached) for the nodes of one group that have new links."""
    table, split = rows[0][1], rows[0][2]
    sides = [[r for r in rows if r[3] == s] for s in (0, 1)] if split else [rows]
    if not all(sides):
        return
    node = [np.array([r[4] for r in s], np.int64) for s in sides]
    copies = [np.array([r[5] for r in s], np.int64) for s in sides]
    label = [np.array([r[6] for r in s], np.int64) for s in sides]
    x = [np.frombuffer(b"".join(r[7] for r in s), np.float64).reshape(len(s), -1) for s in sides]
    keys = [np.array([r[8] for r in s], np.int64) for s in sides]
    a, b = 0, len(sides) - 1
    mask = (x[a] @ x[b].T >= least) & (label[a][:, None] == label[b][None, :])
    if not split:
        np.fill_diagonal(mask, False)
    i, j = np.nonzero(mask)
    for at in range(0, len(i), 65_536):
        p, q = i[at : at + 65_536], j[at : at + 65_536]
        known = (keys[a][p, :table] == keys[b][q, :table]).any(axis=1) if table else np.zeros(len(p), bool)
        mask[p[known], q[known]] = False
    if not mask.any():
        return
    counts = [mask @ copies[b]] + ([mask.T @ copies[a]] if split else [])
    for n, c, r in zip(node, counts, _linked(mask, node[a], node[b] if split else None), strict=False):
        yield from ((int(n[k]), int(c[k]), int(r[k])) for k in np.nonzero(c)[0])


def _compared(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        found: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [*zip(*found, strict=True)] or [[]] * 3
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "links", "root"])
            found.clear()
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][0] != row[0]:
                    if len(rows) > 1:
                        found.extend(_group(rows, least))
                    rows = []
                rows.append(row)
            if len(found) > 10_000:
                yield out()
        if len(rows) > 1:
            found.extend(_group(rows, least))
        yield out()

    return run


def links(nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """node, ``links`` (copies of other nodes linked to it) and ``root`` (a node it is linked to through others), in
    several rows for each node that has links. nodes: node, n, label, vector, keys."""
    each = nodes.select("node", "n", "label", "vector", "keys", F.posexplode("keys").alias("table", "key"))
    sizes, _ = common.written(each.groupBy("key").agg(F.count("*").alias("size")).where(f"size > {BLOCK}"), "embed-sizes")
    parts = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    dealt = each.join(common.bounded(sizes), "key", "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    group = F.xxhash64("key", low, high)
    rows = met.select(group.alias("g"), "table", (low != high).alias("split"), (F.col("own") == high).cast("int").alias("side"), "node", "n", "label", "vector", "keys")
    return rows.repartition("g").sortWithinPartitions("g", "table").mapInArrow(_compared(least), "node long, links long, root long")


def near(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links (other rows linked directly), component_id (the smallest id
    reachable by links) and kept (the id names its component).

    Only rows with equal labels are compared. A row whose label or vector is null, or whose vector is empty, zero or
    has a null or non-finite component, links with nothing and is its own component. Vectors of unequal lengths do
    not link. Repeated rows link with each other; a null id names a component only if all its ids are null. An empty
    table gives an empty result. Other columns are not read.
    """
    slim = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"), F.col(label).cast("long").alias("label"))
    rows, _ = common.written(slim.mapInArrow(_hashed, "id long, node long, label long, vector binary, keys array<long>"), "embed-rows")
    known = rows.where("node IS NOT NULL")
    nodes, _ = common.written(known.groupBy("node").agg(F.min("id").alias("head"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"), F.first("keys").alias("keys")), "embed-nodes")
    found, _ = common.written(links(nodes, least), "embed-links")
    joined = common.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    heads = joined.join(nodes.select("node", "head"), "node")
    named = heads.select("node", "component").join(heads.groupBy("component").agg(F.min("head").alias("least")), "component").select("node", "least")
    counted = nodes.select("node", "head", "n").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(named, "node", "left")
    final = counted.select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("least", "head").alias("least"))
    joined_rows = rows.select("id", "node").join(final, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least"))
    return joined_rows.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op5_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links of cosine 0.93 or more and its component."""
    return near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
