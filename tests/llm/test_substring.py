"""Repeated byte strings: against all windows in a dictionary, and odd inputs."""

import random
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import substring as sub


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + length, bool)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = True
        gone = gone[: len(d)]
        out.append((i, len(d), int(gone.sum()), len(sub.spans(gone)), sub.digest(bytes(b for b, g in zip(d, gone, strict=True) if not g))))
    return sorted(out, key=str)


def got(df, length, k):
    rows = sub.dedup(df, length=length, k=k).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), sub.digest(bytes(r.kept))) for r in rows), key=str)


def test_query_over_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, sub.op4_substring_dedup(spark, sf_dir).collect()), key=str) == brute(rows, 400)


@pytest.mark.parametrize("limit", [2_000, 3])
def test_many_shapes(spark, monkeypatch, limit):
    monkeypatch.setattr(sub, "MAX_GROUP", limit)
    rng = random.Random(limit)
    word = lambda n: "".join(rng.choices("abcé ", k=n))
    common = [word(60) for _ in range(6)]
    rows = [(i, word(rng.randrange(90)) + rng.choice(common)[rng.randrange(20) :] + word(rng.randrange(70)) + rng.choice(common)[: rng.randrange(30, 60)]) for i in range(120)]
    rows += [(200, "ab" * 90), (201, "x" * 100), (202, "y" + "x" * 60), (203, None), (204, ""), (None, rows[3][1]), (3, rows[3][1]), (205, "short")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, h int, row string")
    assert got(df, 25, 8) == brute(rows, 25)
    assert sub.dedup(df.limit(0)).count() == 0


def test_windows_and_long_texts(monkeypatch):
    monkeypatch.setattr(sub, "SEGMENT", 50)
    data = np.random.default_rng(2).integers(97, 100, 700).astype(np.uint8).tobytes()
    covered = [s for start, n, _, _ in sub.contexts(data, 40, 8) for s in range(start, start + n)]
    assert covered == list(range(len(data) - 39))
    h = sub.hashes(np.frombuffer(data * 2, np.uint8), 37)
    assert len(h) == 1400 - 36 and (h[:100] == h[700:800]).all() and len(set(h.tolist())) <= 700
    values = np.random.default_rng(1).integers(0, 1 << 60, 500).astype(np.uint64)
    assert sub.window_least(values, 7).tolist() == [int(values[i : i + 7].min()) for i in range(494)]
