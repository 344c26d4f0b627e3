"""SimHash: against the contract re-read word for word and all pairs, and odd inputs."""

import random
import re

import pandas as pd
import pytest
import xxhash

from gridloom.llm import neardup, simhash

SCHEMA = "doc_id long, text string, fp string, node string, key int"


def brute_fp(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    fps = {i: brute_fp(t) for i, t in rows}
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] > label[j]:
                    label[i], changed = label[j], True
    return {i: (f"{fps[i]:016x}", label[i]) for i in fps}


def got(df):
    rows = simhash.classes(df).collect()
    return {r.doc_id: (f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in rows}


def test_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == brute_classes(rows)


def test_odd_rows_and_clashing_columns(spark):
    rows = [(4, None), (9, ""), (2, " \t\n"), (7, "Ab c"), (5, "aB  c"), (8, "x y z " * 40_000), (3, "É a b c")]
    df = spark.createDataFrame([(*r, "fp", "n", 1) for r in rows], SCHEMA)
    assert got(df) == brute_classes(rows)
    assert got(df)[9][1] == 2


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "only me here")], "doc_id long, text string")
    rows = simhash.classes(df).collect()
    assert len(rows) == 4
    assert sorted(str(r.component_id) for r in rows) == ["1", "1", "1", "None"]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.classes(df).count() == 0


def test_chain_of_links(spark):
    base = 0x1234_5678_9ABC_DEF0
    fps = [base, base ^ 0b11, base ^ 0b1111, base ^ (1 << 62), base ^ (0b111 << 20)]
    frame = spark.createDataFrame(pd.DataFrame({"fp": fps}), "fp long")
    pairs = {frozenset((r.a, r.b)) for r in simhash.links(frame).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in map(tuple, pairs))
    reached, todo = {base}, [base]
    while todo:
        at = todo.pop()
        for p in pairs:
            if at in p and not p <= reached:
                todo += p - reached
                reached |= p
    assert reached == set(fps[:4])


def test_one_row_of_each_group_whatever_the_ids(spark):
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "red green blue cyan pink grey", "oak elm ash fir yew box"]
    df = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3])], "doc_id long, text string")
    assert sorted(r.text for r in neardup.keep_one(df).collect()) == sorted(texts)


def reached(pairs, nodes):
    label = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("radius,m,crowd", [(2, 2, 2048), (2, 2, 3), (2, 4, 2048), (3, 2, 4), (1, 1, 2048), (4, 3, 5), (0, 2, 2048)])
def test_any_radius_and_tables(spark, radius, m, crowd):
    """Clouds of fingerprints about the radius, some of which crowd a segment, against all pairs."""
    own = random.Random(radius * 10 + m)
    fps = set()
    for _ in range(6):
        centre = own.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in own.sample(range(64), own.randint(0, 5))) for _ in range(12)}
        fps |= {centre ^ own.getrandbits(32) << own.choice([0, 32]) for _ in range(6)} | {centre ^ 1 << 63, centre ^ 1 << 31}
    fps = [signed(x) for x in fps]
    frame = spark.createDataFrame(pd.DataFrame({"fp": fps}), "fp long")
    found = [(r.a, r.b) for r in simhash.links(frame, radius, m, crowd).collect()]
    near = lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= radius
    assert all(near(a, b) and a != b for a, b in found)
    assert reached(found, fps) == reached([(a, b) for a in fps for b in fps if a != b and near(a, b)], fps)


def test_tables_by_segment(spark):
    """Two tables of half fingerprints: balls of radius one in the first, the value itself in the second."""
    frame = spark.createDataFrame([(0x00000005_00000003,)], "fp long")
    rows = {(r.mask % (1 << 64), r.at, r.probe) for r in simhash.tables(frame).collect()}
    low, high = 0xFFFFFFFF, 0xFFFFFFFF_00000000
    assert rows == {(low, 0x5_00000003, False), (low, 0x5_00000002, True), (low, 0x5_00000001, True), (high, 0x5_00000003, False)}
    assert len({r.mask for r in simhash.tables(frame, 2, 4).collect()}) == 3
    assert simhash.tables(frame, probes=False).count() == 2
