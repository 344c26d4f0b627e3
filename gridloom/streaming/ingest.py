"""Incremental ingest: pages that arrive as files become table rows, each file once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import tables


def page_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str = "page_id long, url string, html string") -> StreamingQuery:
    """Read Parquet files of pages that are new since the last run, extract their tables and append them."""
    pages = spark.readStream.schema(schema).parquet(source)
    found = tables.page_tables(pages)
    return found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
