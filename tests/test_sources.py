"""Readers, sinks and incremental ingest on files of their own."""

import bz2
import gzip

from pyspark.sql import functions as F

from gridloom.sources import readers, sinks
from gridloom.streaming import ingest


def test_xml_dump(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<mediawiki><page><title>A</title><ns>0</ns><revision><text>x\n== H ==\ny</text></revision></page><page><title>File:B</title><revision><text>z</text></revision></page></mediawiki>')
    pages = readers.xml_pages(spark, str(tmp_path / "d.xml"))
    assert {(r.title, r.skip_reason) for r in readers.article_filter(pages).collect()} == {("A", "length"), ("File:B", "namespace")}
    assert [(r.heading, r.body) for r in readers.sections(pages.where("title = 'A'")).orderBy("pos").collect()] == [("Introduction", "x"), ("H", "y")]
    assert [r.title for r in readers.missing(pages, pages.where("title = 'A'")).collect()] == ["File:B"]


def test_compressed_pages(spark, tmp_path):
    (tmp_path / "a.html.bz2").write_bytes(bz2.compress(b"<p>one\ntwo</p>"))
    [row] = readers.html_pages(spark, str(tmp_path)).collect()
    assert row.html == "<p>one\ntwo</p>" and row.path.endswith("a.html.bz2")


def test_text_formats(spark, tmp_path):
    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write('a\t"1,5\nb\t2,25\n')
    rows = readers.tsv(spark, str(tmp_path / "t.tsv.gz"), "k string, v string").select(readers.decimal_comma(F.replace("v", F.lit('"'), F.lit(""))).alias("v")).collect()
    assert [r.v for r in rows] == [1.5, 2.25]
    lines = spark.createDataFrame([("<a> <b> \"c d\" .",), ("junk",)], "value string")
    assert [tuple(r) for r in readers.n_triples(lines).collect()] == [("<a>", "<b>", '"c d"')]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1.1", 0, "x"), ("1.2", 2, "y")], "tableId string, origin int, title string")
    sinks.tables_json(df, str(tmp_path / "j"))
    assert {r.title for r in readers.table_json(spark, str(tmp_path / "j")).collect()} == {"x", "y"}
    sinks.by_origin(df, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).where("origin = 2").count() == 1
    sinks.tsv(df, str(tmp_path / "t"))
    assert readers.tsv(spark, str(tmp_path / "t"), "a string, b int, c string").count() == 2


def test_incremental_ingest(spark, tmp_path):
    page = "<table class=w><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for i in (1, 2):
        spark.createDataFrame([(i, "u", page)], "page_id long, url string, html string").write.mode("append").parquet(source)
        ingest.page_stream(spark, source, sink, check).awaitTermination()
        assert spark.read.parquet(sink).count() == i
