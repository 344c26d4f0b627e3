"""Toxicity: held-out accuracy, the ordinal model itself, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import toxicity


def test_fit_recovers_an_ordinal_model():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = np.searchsorted([1.0, 3.0], x @ [4.0, -2.0, 0.0] + rng.logistic(size=4000))
    w, theta = toxicity.fit(toxicity.Sparse.of(x), y, 3, decay=0.0)
    assert np.allclose(w, [4, -2, 0], atol=0.5) and np.allclose(theta, [1, 3], atol=0.5)


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.hash("doc_id"), F.lit(4)) == 0
    model = toxicity.train(docs, labels.where(~held))
    rows = toxicity.score(docs, model, keep=["doc_id"]).join(labels.where(held), "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.rejected for r in toxic) >= 0.6 * len(toxic)
    assert sum(r.rejected for r in clean) <= 0.02 * len(clean)
    assert np.mean([r.severity for r in toxic]) > 4 * np.mean([r.severity for r in clean])
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.grade < toxicity.GRADES for r in rows)


@pytest.fixture
def odd(spark):
    rows = [(1, None), (2, ""), (None, "you fool"), (4, "nice day " * 50_000), (5, "fool fool fool"), (5, "fool fool fool")]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, words string")


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1), (1, 0), (2, 0), (4, 0), (4, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 6 and rows[0].words == "x"
    with pytest.raises(ValueError):
        toxicity.score(odd.withColumnRenamed("words", "grade"), model)
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_nothing_to_learn(spark, odd):
    for labels in ([], [(1, 0)], [(5, 1)]):
        model = toxicity.train(odd, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert not any(r.rejected or r.severity for r in toxicity.score(odd, model).collect())


def test_given_grades(spark):
    rows = [(i, "bad " * (i % 3) + "word " * 20) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("level"))
    model = toxicity.train(docs, labels, label="level", grade="level")
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(model.thresholds) == 2
    assert found[2].severity > found[1].severity > found[0].severity
