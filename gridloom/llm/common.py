"""What the operators of this subpackage share: tables in the shared folder, sizes, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

#: A frame is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, a local session gets a
    temporary one; on a cluster, whose executors could not see it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The frame written as Parquet in the shared folder and read again, and its path: this cuts the lineage and
    outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that a worker holds few rows as Python objects at once. After the last one
    the worker, which other tasks use again, gives free memory back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    """Return free memory of this worker to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`written` that no frame reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most so many rows; otherwise as it is, for a shuffle join whose
    skewed keys adaptive execution splits."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def one_of_each(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of docs for each ``component`` of found (row, the xxhash64 of a text, and component): the one with the
    smallest id, a null id only where the whole component has none; ties go to the least hash of the row."""
    key, own = "_row_of_near_dedup", F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))
    slim = docs.select(F.xxhash64(text).alias("row"), F.col(doc_id).alias("id"), own.alias("own"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "own"))["own"]
    kept = slim.join(found, "row").groupBy("component").agg(least.alias(key)).select(key)
    return docs.withColumn(key, own).join(kept, key, "left_semi").dropDuplicates([key]).drop(key)


#: A node with more than this share of all edges is crowded; so there are fewer than twice its inverse of them.
CROWDED = 1 / 500


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star contraction.

    edges: two columns ``a`` and ``b`` of one orderable type. Returns ``node`` and ``component`` (its smallest node)
    for every node that has an edge to another one. Each round is two grouped minima (combined before the shuffle) and
    two joins on the node. The minima of crowded nodes, 1,000 at most, are broadcast, so that their edges stay where they
    are; so a node that has a third of all edges is never gathered in one task. Rounds, whose number grows with the
    logarithm of the longest path, are written to the shared folder. Null ends and loops are left out; an empty graph has
    no components.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType
    now, path = written(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    seen = _state(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        large, between = written(_large_star(now, seen[0]), "edges")
        after, next_path = written(_small_star(large, large.count()), "edges")
        state = _state(after)
        done = state == seen
        remove(spark, path)
        remove(spark, between)
        now, path, seen = after, next_path, state
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _beside(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """rows (a, b) with the ``m`` of their node a in least (a, m, n); n: the node's edges, of so many in all."""
    if edges <= BROADCAST_ROWS:
        return rows.join(F.broadcast(least.select("a", "m")), "a")
    crowd = F.broadcast(least.where(F.col("n") > edges * CROWDED).select("a", F.col("m").alias("_m")))
    marked = rows.join(crowd, "a", "left")
    rest = marked.where("_m IS NULL").select("a", "b").join(least.select("a", "m"), "a")
    return marked.where("_m IS NOT NULL").select("a", "b", F.col("_m").alias("m")).unionByName(rest)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours. Edges have a > b."""
    larger = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = edges.unionByName(larger).groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _beside(larger, least, n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of these neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = _beside(edges, least, n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
