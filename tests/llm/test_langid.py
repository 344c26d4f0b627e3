"""Language ID: held-out accuracy, the use of each kind of evidence, and odd inputs."""

import pytest
from pyspark.sql import functions as F

from gridloom.llm import langid

BASE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    return langid.train(docs.where(F.pmod(F.hash("doc_id"), F.lit(4)) != 0))


def test_held_out_text_alone(spark, model):
    docs = spark.read.parquet(f"{BASE}/documents.parquet").where(F.pmod(F.hash("doc_id"), F.lit(4)) == 0)
    rows = langid.identify(docs.withColumn("url", F.lit("http://a.b.c/")), model, "doc_id", "url", "text").join(docs.select("doc_id", F.col("lang").alias("truth")), F.col("page_id") == F.col("doc_id")).collect()
    assert sum(r.lang == r.truth for r in rows) >= 0.95 * len(rows)


def test_pages_follow_their_declaration(spark):
    rows = langid.op6_language(spark, BASE).collect()
    assert len(rows) == 250 and all(0 < r.p_lang <= 1 for r in rows)
    assert sum(r.lang == r.declared for r in rows) >= 0.95 * len(rows)


def test_host_and_declaration_decide_without_text(spark, model):
    german = "<html lang='de'><p>die und der nicht erung einkeit schung ungen der das verbe</p></html>"
    pages = [(i, f"http://{'www' if i % 2 else 'x'}.eins.example/{i}", german) for i in range(30)]
    pages += [(100, "http://www.eins.example/none", ""), (101, "http://new.eins.example/none", None), (102, None, "<html LANG=de>"), (103, "nonsense", "<p>Is and the of thouing onen</p>")]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, host string")
    rows = {r.page_id: r for r in langid.identify(df, model).collect()}
    assert len(rows) == len(pages) and all(rows[i].lang == "de" for i in (0, 1, 100, 101, 102)) and rows[103].lang == "en"
    assert rows[100].p_lang >= rows[101].p_lang


def test_odd_rows(spark, model):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "", ""), (4, "http://h/", "x " * 200_000)], "page_id long, url string, html string")
    assert len(langid.identify(df, model).collect()) == 4
    assert langid.identify(df.limit(0), model).count() == 0
    nothing = langid.train(spark.createDataFrame([(1, None, "en"), (2, "x", None)], "doc_id long, text string, lang string"))
    assert {r.lang for r in langid.identify(df, nothing).collect()} == {None}
