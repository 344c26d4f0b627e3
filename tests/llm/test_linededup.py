"""Line dedup: against all pairs by exact Jaccard similarity, and odd inputs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gridloom.llm import linededup as ld


def brute(rows):
    """removed line numbers by row, links over all pairs of lines"""
    places = [(i is None, i or 0, n, k, ld.normal(x)) for n, (i, t) in enumerate(rows) for k, x in enumerate((t or "").split("\n")) if x.strip()]
    texts = sorted({p[-1] for p in places})
    sets = {t: {t[i : i + ld.K] for i in range(max(1, len(t) - ld.K + 1))} for t in texts}
    head = {t: t for t in texts}

    def find(t):
        while head[t] != t:
            t = head[t]
        return t

    for n, a in enumerate(texts):
        for b in texts[:n]:
            if len(sets[a] & sets[b]) >= ld.LEAST * len(sets[a] | sets[b]):
                head[find(a)] = find(b)
    first = {}
    for p in sorted(places):
        first.setdefault(find(p[-1]), p)
    out = {n: [] for n in range(len(rows))}
    for p in places:
        if first[find(p[-1])] != p:
            out[p[2]].append(p[3])
    return [sorted(out[n]) for n in range(len(rows))]


def test_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in ld.op3_line_dedup(spark, sf_dir).collect()}
    for (i, text), gone in zip(rows, brute(rows), strict=True):
        lines = text.split("\n")
        assert got[i].removed_lines == gone and got[i].n_lines == len(lines) and got[i].n_removed == len(gone)
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_recall_at_the_threshold():
    rng = random.Random(5)
    hits = total = 0
    for _ in range(300):
        a = "".join(rng.choices("abcdefghij ", k=200))
        at = rng.randrange(100)
        b = a[:at] + "".join(rng.choices("klmno", k=8)) + a[at + 8 :]
        if ld.jaccard(a, b) >= ld.LEAST:
            x, y = ld.bands([a, b])
            total, hits = total + 1, hits + bool((x == y).any())
    assert total > 200 and hits >= 0.98 * total


def test_similar_pairs_are_exact():
    rng = random.Random(8)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choices("abcé ", k=rng.randrange(1, 120)))
        at = rng.randrange(len(a))
        pairs.append((a, a[:at] + "x" * rng.randrange(4) + a[at:]))
    assert ld.similar(*map(list, zip(*pairs, strict=True))) == [i for i, (a, b) in enumerate(pairs) if ld.jaccard(a, b) >= ld.LEAST]
    assert ld.similar([], []) == []


@pytest.fixture
def odd():
    long = "x yz " * 60_000
    return [(3, None), (1, ""), (2, "Same line here ok\n\n \nsame line here OK "), (5, "Same line here ok"), (None, "only in the null row"), (6, "only in the null row"), (7, long), (8, long + "w"), (9, "ab\nab\nabc")]


def test_odd_rows(spark, odd):
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in odd], "doc_id long, text string, row int, node string")
    rows = {r.doc_id: r for r in ld.dedup(df).collect()}
    assert len(rows) == len(odd) and rows[5].row == 1 and rows[5].node == "r"
    assert [rows[i]._removed for i, _ in odd] == brute(odd)
    assert rows[3].text is None and rows[3]._n_lines == 0 and rows[5].text == "" and rows[2].text == "Same line here ok\n\n "
    assert rows[8].text == "" and rows[9].text == "ab\nabc" and rows[None].text == ""


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one line of text")] * 3 + [(2, "one line of text")], "doc_id long, text string")
    rows = ld.dedup(df).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, "one line of text")] * 3 + [(2, "")]
    assert ld.dedup(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one line of text\nown", 7, "r", 1), (2, "other\none line of text", 8, "s", 2)], "doc_id long, text string, _n_lines int, _removed string, component int")
    rows = {r.doc_id: r for r in ld.dedup(df).collect()}
    assert rows[2].text == "other" and rows[2]._removed == [1] and rows[2]._n_lines == 2 and rows[2].component == 2
    assert rows[1].text == "one line of text\nown" and rows[1]._removed == []


@pytest.mark.parametrize("gone", [[], [0], [4], [0, 1, 2, 3, 4], [1, 3], [0, 2, 3]])
def test_lines_without(spark, gone):
    lines = ["a", "", "c", "d", ""]
    df = spark.createDataFrame([(lines, gone)], "lines array<string>, gone array<int>")
    assert df.select(ld.without(df.lines, df.gone).alias("x")).first().x == [x for i, x in enumerate(lines) if i not in gone]


def test_many_lines_of_one_text_go(spark):
    lines = [f"line of the text {i} {i * i} {i ** 3}" for i in range(30_000)]
    df = spark.createDataFrame([(1, "\n".join(lines[::2])), (2, "\n".join(lines))], "doc_id long, text string")
    same = ld.without(F.split("text", "\n", -1), F.sequence(F.lit(0), F.lit(14_999)))
    assert df.where("doc_id = 2").select(same.alias("x")).first().x == lines[15_000:]


def test_pairs_in_a_family_below_the_threshold(spark):
    """Lines that share much of their text without being similar, among them pairs that are."""
    rng = random.Random(11)
    draw = lambda k: "".join(rng.choices("abcdefghijklmnop", k=k))
    base, lines = draw(240), []
    for n in range(400):
        lines.append(base + draw(35))
        if n % 10 == 0:
            at = rng.randrange(50, 150)
            lines.append(lines[-1][:at] + draw(14) + lines[-1][at + 14 :])
    assert ld.jaccard(lines[0], lines[2]) < ld.LEAST <= ld.jaccard(lines[0], lines[1])
    rng.shuffle(lines)
    rows = list(enumerate(lines))
    done = ld.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r._removed for r in done.collect()}
    assert [got[i] for i, _ in rows] == brute(rows)


def test_pairs_of_several_chunks_counted_at_once():
    """Different shingles of each line, numbered by its place; pairs beyond a chunk are compared like the first ones."""
    lines = ["", "a", "short one", "abcdefgh" * 9, "é" * 40, "x" * 2000] * 20
    places = (ld._marked(lines) >> ld._ROW).tolist()
    assert [places.count(i) for i in range(len(lines))] == [len({t[i : i + ld.K] for i in range(max(1, len(t) - ld.K + 1))}) for t in lines]
    a, b = lines * 3, [x + "z" for x in lines * 3]
    assert len(a) > 2 * ld.CHUNK and ld.similar(a, b) == [i for i in range(len(a)) if ld.jaccard(a[i], b[i]) >= ld.LEAST]


def test_jaccard_of_packed_shingles(monkeypatch):
    rng = random.Random(12)
    lines = ["", "ab", "ab\0", "abcdefg\0", "abcdefg", "éè" * 9, "ab" * 40, "abœ" * 12]
    lines += ["".join(rng.choices(alphabet, k=rng.randrange(1, 1500))) for alphabet in ("ab\0", "aé", "aœ") for _ in range(8)]
    plain = lambda t: {t[i : i + ld.K] for i in range(max(1, len(t) - ld.K + 1))}
    for a in lines:
        for b in lines:
            assert ld.jaccard(a, b) == len(plain(a) & plain(b)) / len(plain(a) | plain(b))
    ld._short_set.cache_clear()

    def refuse(line):
        raise AssertionError(line)

    monkeypatch.setattr(ld, "_set", refuse)
    monkeypatch.setattr(ld, "_short_set", refuse)
    assert ld.jaccard("eine zeile über äpfel", "eine zeile über äpfel") == 1 and ld.jaccard("x" * 2000, "y" * 2000) == 0
