"""Embedding near-dedup: against all pairs, and odd inputs. (The query has its SQL.)"""

import numpy as np

from gridloom.llm import embed


def brute(rows):
    units = [None if label is None else embed.unit(v) for _, v, label in rows]
    n = len(rows)
    link = [[i != j and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= 0.93 for j in range(n)] for i in range(n)]
    comp = [r[0] for r in rows]
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in range(n) if link[i][j])]) for i in range(n)]
    return sorted((rows[i][0], sum(link[i]), comp[i], rows[i][0] == comp[i]) for i in range(n))


def test_clusters_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(32)
        rows += [((c * 37 + k * 101) % 5000, (centre + rng.standard_normal(32) * s).tolist(), c % 2) for k, s in enumerate(rng.uniform(0.05, 0.45, 12))]
    rows += [(6000 + k, [1.0] * 32, 0) for k in range(40)] + [(6100, [2.0] * 32, 0), (6101, [1.0] * 32, 1), (6102, [1.0] * 32, None)]
    rows += [(7000, None, 0), (7001, [0.0] * 32, 0), (7002, [float("nan"), 1.0], 0), (7003, [], 0), (7004, [None, 1.0], 0), (7005, [1.0, 1.0], 0), (7006, [1e300, 1e300], 0), (7007, [1.0] * 32, 0)]
    df = spark.createDataFrame([(*r, "node", 3) for r in rows], "vec_id long, embedding array<double>, label int, node string, n int")
    assert sorted(map(tuple, embed.near(df).collect())) == brute(rows)


def test_null_and_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (None, None, 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(str, (tuple(r) for r in embed.near(df).collect()))) == sorted(["(3, 2, 3, True)", "(3, 2, 3, True)", "(None, 2, 3, False)", "(None, 0, None, True)"])
    assert embed.near(df.limit(0)).count() == 0
