"""The corpus pipeline: every stage on its predecessor's result, and odd inputs."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.abspath(os.path.join(os.path.dirname(__file__), "..", "..")))
import corpus_pipeline as cp  # noqa: E402

from gridloom.llm import common, simhash  # noqa: E402

BASE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        docs, _ = common.written(stage(spark, docs, BASE), f"test-{name}")
        out.append(docs)
    return out


def test_columns_and_names(results):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "bpe"]
    assert all(r.columns == cp.COLUMNS for r in results[1:-1])


def test_toxicity_keeps_clean_documents(spark, results):
    labels = spark.read.parquet(f"{BASE}/labels.parquet")
    gone = results[0].join(results[1], "doc_id", "left_anti").join(labels, "doc_id").collect()
    assert gone and sum(r.toxic for r in gone) >= 0.95 * len(gone)
    assert results[1].join(results[0], ["doc_id", "text"], "left_anti").count() == 0


def test_lines_are_there_once(results):
    assert results[2].count() == results[1].count()
    lines = results[2].select(F.explode(F.split("text", "\n")).alias("l")).select(F.lower(F.trim("l")).alias("l")).where("l <> ''")
    assert lines.count() == lines.distinct().count()


def test_one_of_each_group(results):
    left = {(r.fp, r.component_id) for r in simhash.classes(results[3]).collect()}
    assert len(left) == results[3].count()
    before = {r.component_id for r in simhash.classes(results[2]).collect()}
    assert {r.doc_id for r in results[3].collect()} == before


def test_mixing_takes_every_document(results):
    taken = results[4].groupBy("doc_id").count()
    assert taken.count() == results[3].count() and results[4].count() > results[3].count()
    assert taken.agg(F.max("count")).first()[0] <= 2


def test_tokens_decode_exactly(results):
    assert results[5].count() == results[4].count()
    assert results[5].where("NOT round_trip OR n_tokens <> size(ids)").count() == 0


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "same line", "en", "a", 9), (4, "same line", "en", "b", 9), (4, "same line", "en", "b", 9)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rejected string")
    for name, stage in cp.STAGES:
        docs, _ = common.written(stage(spark, docs, BASE), f"odd-{name}")
        assert docs.count() > 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        empty, _ = common.written(stage(spark, empty, BASE), f"empty-{name}")
        assert empty.count() == 0
