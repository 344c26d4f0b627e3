"""Mixing: weights by the definition, budgets to the token, and odd inputs. (The query has its SQL.)"""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing

SIZES = {"a": 600, "b": 300, "c": 90, "d": 10}


@pytest.fixture
def shares(spark):
    return spark.createDataFrame([(s, n / 1000) for s, n in SIZES.items()], "source string, share double")


def weights(alpha):
    z = sum((n / 1000) ** alpha for n in SIZES.values())
    return {s: (n / 1000) ** alpha / z for s, n in SIZES.items()}


def test_exponent_meets_targets(shares):
    a = mixing.exponent(shares, max_repetition=4.0, budget=1.0)
    assert max(w * 1000 / SIZES[s] for s, w in weights(a).items()) == pytest.approx(4.0, rel=1e-6)
    a = mixing.exponent(shares, target_entropy=1.2)
    assert -sum(w * math.log(w) for w in weights(a).values()) == pytest.approx(1.2, rel=1e-6)
    assert mixing.exponent(shares, target_entropy=9.0) == 0.0
    assert mixing.exponent(shares, target_entropy=0.1) == 1.0
    assert mixing.exponent(shares, max_repetition=1000.0) == 0.0
    a = mixing.exponent(shares, max_repetition=2.0, budget=None)
    w = weights(a)
    assert (w["d"] / 10) / (w["a"] / 600) == pytest.approx(2.0, rel=1e-6)
    with pytest.raises(ValueError):
        mixing.exponent(shares)


@pytest.mark.parametrize("budget", [None, 0.5, 2.0])
def test_budgets_and_permutations(spark, budget):
    docs = [(i, s, 1 + (i * 7) % 5) for k, (s, n) in enumerate(SIZES.items()) for i in range(137 * k, 137 * k + n)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n long")
    plan = {r.source: r for r in mixing.weights(df.withColumnRenamed("n", "tokens"), None, 2.5, budget).collect()}
    rows = mixing.mix(df, tokens=F.col("n"), max_repetition=2.5, budget=budget, seed=7).collect()
    size = {(i, s): n for i, s, n in docs}
    assert len(size) == len(docs)
    for s in SIZES:
        taken = Counter((r.doc_id, r._epoch) for r in rows if r.source == s)
        assert set(taken.values()) <= {1}
        total = sum(size[i, s] for i, _ in taken)
        assert 0 <= plan[s].quota - total < 5 and sum(e == plan[s].full + 1 for _, e in taken) < SIZES[s]
        for e in range(1, plan[s].full + 1):
            assert sum(k == e for _, k in taken) == SIZES[s]
    orders = defaultdict(list)
    for r in rows:
        orders[r.source, r._epoch].append((r._order, r._block))
    for o in orders.values():
        blocks = [b for _, b in sorted(o)]
        assert len({*blocks}) == sum(x != y for x, y in zip([None, *blocks], blocks, strict=False)) or len(blocks) < 2


def test_odd_rows(spark):
    rows = [(1, None, "a b"), (2, "s", None), (2, "s", None), (None, "s", ""), (5, "t", "w " * 90_000), (6, "empty", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, tokens int")
    out = mixing.mix(df, max_repetition=2.0, budget=None).collect()
    assert {(r.doc_id, r.source) for r in out} == {(r[0], r[1]) for r in rows} and {r.tokens for r in out} == {1}
    assert mixing.mix(df.limit(0), max_repetition=2.0, budget=None).count() == 0


def test_clashing_columns(spark):
    names = ["full", "rest", "cut", "_source", "_key", "_mix_full", "_Mix_Key", "tokens", "weight"]
    df = spark.range(40).selectExpr("id AS doc_id", "if(id < 30, 'a', 'b') AS source", "'x y' AS text", *(f"concat('{c}', id) AS {c}" for c in names), "-1 AS _epoch", "'no' AS _block")
    plain = df.select("doc_id", "source", "text")
    got = mixing.mix(df, max_repetition=2.0, budget=None)
    assert got.columns == ["doc_id", "source", "text", *names, "_epoch", "_block", "_order"]
    assert all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in names)
    same = [(r.doc_id, r._epoch, r._block, r._order) for r in mixing.mix(plain, max_repetition=2.0, budget=None).collect()]
    assert sorted((r.doc_id, r._epoch, r._block, r._order) for r in got.collect()) == sorted(same)
