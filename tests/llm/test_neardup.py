"""The pipeline's near dedup: against all pairs by exact five-word Jaccard similarity."""

import os
import random
import sys

sys.path.insert(0, os.path.abspath(os.path.join(os.path.dirname(__file__), "..", "..")))
import corpus_pipeline as cp  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """ids that stay: the least of each group of links over all pairs"""
    sets, label = {}, {i: i for i, _ in rows}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return set(label.values())


def test_stage_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = [(900, None), (901, ""), (902, " \n"), (903, "only four words here"), (904, "Only four  words here")]
    for words, edits, copies in ((200, 1, 12), (500, 8, 12), (2000, 30, 6), (2000, 4, 6), (200, 12, 12)):
        for _ in range(copies):
            text = [word() for _ in range(words)]
            rows.append((len(rows), " ".join(text)))
            for at in rng.sample(range(words), edits):
                text[at] = word()
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], SCHEMA)
    got = sorted(r.doc_id for r in cp.near_dedup(spark, docs, "").collect())
    assert got == sorted(brute(rows)) and len(got) < len(rows) - 30


def test_near_fingerprints_are_a_bucket(spark):
    import numpy as np

    from gridloom.llm import neardup, simhash

    rng = random.Random(5)
    text = [f"w{rng.randrange(5000)}" for _ in range(1500)]
    edited = [*text[:700], "edited", *text[701:]]
    texts = [" ".join(text), " ".join(edited), " ".join(f"v{rng.randrange(5000)}" for _ in range(1500))]
    a, b, c = simhash.fingerprints(texts, neardup.SIZE)
    assert 0 < int(a ^ b).bit_count() <= neardup.RADIUS < int(a ^ c).bit_count()
    nodes = spark.createDataFrame([(i, int(np.array(f).view(np.int64))) for i, f in enumerate((a, b, c))], "node long, fp long")
    keys = {r.node: r.key for r in neardup.near_prints(nodes).collect()}
    assert keys[0] == keys[1] != keys[2]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, "").collect()) == [0, 2]
