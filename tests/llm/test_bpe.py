"""Byte-level BPE: against the tiktoken library, and the exact round trip."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(bpe.load_ranks(PATH), PATTERN)


@pytest.fixture(scope="module")
def theirs(own):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_perfect_hash_is_minimal(own):
    assert sorted(own.hash.slots) == list(range(len(own.tokens)))
    assert all(own.hash.find(t) == i for i, t in enumerate(own.tokens))
    assert own.hash.find(b"no such token at all") == -1
    assert bpe.PerfectHash([]).find(b"a") == -1 and bpe.PerfectHash([b"x"]).find(b"x") == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r 　'sdl.1"), st.characters(exclude_categories=["Cs"]))))
def test_like_the_library(own, theirs, text):
    ids = own.encode(text).tolist()
    assert ids == theirs.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_long_runs(own, theirs):
    for text in ("a" * 30_000, "<|endoftext|>" * 50, " x" * 5000, "=" * 9999 + " \n\n  é" * 300):
        assert own.encode(text).tolist() == theirs.encode_ordinary(text)


def test_query_over_documents(spark, theirs, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = bpe.op1_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (None, " a", "k"), (None, " a", "k")], "doc_id long, text string, ids string")
    shared = bpe.codec(spark, PATH, PATTERN)
    rows = bpe.digests(df, shared).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == [("1", 0), ("2", 0), ("None", 1), ("None", 1)]
    with pytest.raises(ValueError):
        bpe.encode(df, shared)
    assert bpe.digests(df.limit(0), shared).count() == 0
    back = bpe.decode(spark.createDataFrame([(None,), ([],), ([64, 65],)], "ids array<int>"), shared).collect()
    assert [None if r.decoded is None else bytes(r.decoded) for r in back] == [None, b"", b"ab"]


def test_checked_in_one_pass(spark, theirs):
    df = spark.createDataFrame([(1, None), (2, ""), (None, " a\n b, c"), (3, "x " * 5000), (3, "x " * 5000)], "doc_id long, text string")
    shared = bpe.codec(spark, PATH, PATTERN)
    rows = bpe.checked(df, shared).collect()
    assert len(rows) == 5 and all(r.round_trip and r.n_tokens == len(r.ids) and r.ids == theirs.encode_ordinary(r.text or "") for r in rows)
    assert bpe.checked(df.limit(0), shared).count() == 0
    with pytest.raises(ValueError):
        bpe.checked(df.withColumn("round_trip", df.text), shared)


def test_few_remembered(own, theirs):
    """A cache of a few entries forgets all the time and changes no id."""
    small = bpe.Codec(own.tokens, PATTERN)
    small.pieces = bpe.Pieces(own.pieces.find, own.encode_token, budget=2000)
    text = " ".join(f"w{i % 37}, {'y' * (i % 90)} (z{i})" for i in range(3000)) + "\nend of  it"
    for _ in range(2):
        assert small.encode(text).tolist() == theirs.encode_ordinary(text)
    held = small.pieces.pieces
    assert held.held <= 2000 and len(held) + len(held.older) < 60 and max(map(len, [*held, *held.older])) <= 64


@pytest.mark.parametrize("text", ["ab.\ncd, ef\n", "\nab\ncd", "a\n\nb c\n\n", "a b\n", " a\tb\nc d", "a\r\nb c", "a \n b", "x\n\n\ny z.\n?! w", "one's\n'tis we'd, ok.,\n"])
def test_line_feeds_and_spaces(own, theirs, text):
    assert own.encode(text).tolist() == theirs.encode_ordinary(text)


def test_texts_together(own, theirs):
    """A word is made once and held once, whatever stands behind it and in whichever text it is; the ids are the library's."""
    made = []
    small = bpe.Pieces(own.pieces.find, lambda token: made.append(token) or own.encode_token(token))
    texts = ["see the zorblat, zorblat.\nand zorblat", None, "", "the  zorblat \n\n", "a zorblat. the zorblat"] * 3
    flat, sizes = small.many(texts)
    assert sizes.tolist() == [len(theirs.encode_ordinary(x or "")) for x in texts]
    assert flat.tolist() == [i for x in texts for i in theirs.encode_ordinary(x or "")]
    assert made.count(" zorblat") == 1 and not any("zorblat" in x and x != "zorblat" for x in small.pieces)
    assert [x.tolist() for x in small.many([])] == [[], []]
