"""Multiset fingerprints: contract columns against Python, the homomorphism, and odd inputs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import multiset as ms


def expected(rows):
    """(id, n_chars, sha of the edited text, next id) by the contract, in Python"""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for (i, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return out


def check(df, rows):
    got = ms.compared(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(expected(rows), key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    return got


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = check(docs, rows)
    own = {r.doc_id: r.fingerprint for r in ms.fingerprint(docs).collect()}
    assert own == {r.doc_id: r.fingerprint for r in got}
    texts = dict(rows)
    assert len({r.fingerprint for r in got}) == len(set(texts.values()))
    long = [r for r in got if r.n_chars > 300 and r.near_next < 0.5]  # the next may be a near copy
    assert sum(r.near_edited > r.near_next for r in long) >= 0.99 * len(long)
    assert 0.3 < sum(r.near_edited for r in long) / len(long) < 0.8


def test_ids_far_apart(spark):
    rows = [(-(2**63), "low é"), (2**63 - 1, "high text here"), (0, "zero 𝄞𝄞"), (5, "five"), (511, "a b c d"), (512, "next bucket"), (10**12, "x y z w")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n \n"), (None, "null id"), (7, "same"), (7, "same"), (9, "w " * 100_000), (8, "ééé")]
    got = check(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, bucket int, place int"), rows)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint
    assert by[2].near_next == 1.0
    assert ms.compared(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = ms.compared(spark.createDataFrame([(4, "only one document")], "doc_id long, text string")).collect()[0]
    assert one.near_next == 1.0


def test_order_insertion_and_deletion(spark):
    texts = ["a b c d\nsecond line here\na b c d", "a b c d\na b c d\n\nsecond line here", "second line here", "a b c d\na b c d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ms.fingerprint(df).orderBy("doc_id").collect()
    assert rows[0].fingerprint == rows[1].fingerprint != rows[3].fingerprint
    wide = df.withColumn("w", ms.strong(F.col("text"))).alias("x")
    whole, part, rest = ([r.w for r in wide.where(F.col("doc_id") == i).collect()][0] for i in (0, 2, 3))
    frame = spark.createDataFrame([(whole, part, rest)], "whole array<long>, part array<long>, rest array<long>")
    row = frame.select(ms.combine(F.col("part"), F.col("rest"), ms.WIDE), ms.combine(F.col("whole"), F.col("part"), ms.WIDE, -1)).first()
    assert row[0] == whole and row[1] == rest
    assert len(set(whole)) == len(whole)


@pytest.mark.parametrize("text", ["a b c\nx y z", "one", ""])
def test_runs(spark, text):
    row = spark.createDataFrame([(text,)], "text string").select(ms.runs(F.col("text"))).first()
    assert len(row[0]) == (0 if not text else 1 + text.count("\n"))


def test_likeness_of_long_texts(spark):
    texts = ["\n".join(" ".join(f"{c}{i}x{k}" for k in range(1000)) for i in range(101)) for c in "ab"]
    got = ms.compared(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.near_next < 0.4 and 0.2 < r.near_edited < 0.8 for r in got)
