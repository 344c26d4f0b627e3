"""Sinks: JSON, TSV, CSV, Parquet by origin, bucketed lookup tables, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tables_json(tables: DataFrame, path: str) -> None:
    tables.write.mode("overwrite").option("compression", "gzip").json(path)


def tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "gzip").csv(path, sep="\t", quote="")


def feature_lines(rows: DataFrame, features: list[str], tail: list[str], path: str | None = None) -> DataFrame:
    """Triples as text lines ``k:v ... tail`` with tabs; written if a path is given."""
    line = F.concat_ws("\t", *(F.concat_ws(":", F.lit(f.removeprefix("f")), F.col(f)) for f in features), *tail)
    out = rows.select(line.alias("value"))
    if path:
        out.write.mode("overwrite").text(path)
    return out


def by_origin(triples: DataFrame, path: str, origin: str = "origin") -> None:
    """Triples parted by their origin, so that a reader of one origin prunes the others."""
    triples.repartition(origin).write.mode("overwrite").partitionBy(origin).parquet(path)


def lookup_table(rows: DataFrame, name: str, key: str, buckets: int = 64) -> None:
    """A table bucketed and sorted by its key: joins on the key need no shuffle of it."""
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def jdbc(triples: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    triples.write.mode("append").jdbc(url, table, properties=properties)
