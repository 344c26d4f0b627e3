"""Token files: against the library on whole texts, exact round trips, and odd inputs."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import common, dac

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def made():
    with open(PATH, encoding="utf-8") as file:
        json = file.read()
    return {p: dac.LibraryPieces(json, p, budget=3000) for p in (None, public_tokenizers.PATTERN)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), max_size=4))
def test_round_trip(texts):
    shard = dac.Shard(dac.pack(list(range(len(texts))), [np.array(t, np.uint32) for t in texts]))
    flat = [x for t in texts for x in t]
    assert shard.all().tolist() == flat and len(shard) == len(flat)
    assert [shard[i] for i in range(0, len(flat), 13)] == flat[::13]
    assert shard.doc_ids == list(range(len(texts))) and shard.starts[-1] == len(flat)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdl.1éß<|>"), st.characters(exclude_categories=["Cs"]))))
@pytest.mark.parametrize("pattern", [None, public_tokenizers.PATTERN])
def test_pieces_like_whole_texts(library, made, pattern, text):
    assert np.frombuffer(made[pattern].ids(text), "<i4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bad_shards():
    with pytest.raises(ValueError):
        dac.Shard(b"something else, and long enough for a header")
    with pytest.raises(ValueError):
        dac.pack([1, None], [np.zeros(1)] * 2)
    with pytest.raises(IndexError):
        dac.Shard(dac.pack([], []))[0]


def expected(rows, library):
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_over_documents(spark, library, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, dac.op10_token_files(spark, sf_dir).collect())) == sorted(expected(rows, library))


def test_odd_rows_and_many_shards(spark, library):
    rows = [(5, "<|endoftext|> a  b\n c"), (2, None), (9, ""), (None, "x y"), (2, "again"), (7, " lead " * 3000), (3, "tail ")]
    df = spark.createDataFrame([(*r, "tokens", 1) for r in rows], "doc_id long, text string, path string, base int")
    shared = spark.sparkContext.broadcast(dac.Tokenizing(PATH, public_tokenizers.PATTERN))
    manifest = dac.write(df, shared, common.fresh_path(spark, "t"), shard_tokens=4)
    assert manifest.count() >= 4
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, dac.checks(manifest).collect()), key=key) == expected(rows, library)
    assert dac.checks(dac.write(df.limit(0), shared, common.fresh_path(spark, "t"))).count() == 0


def test_added_tokens_as_the_library_has_them(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    texts = ["one text<|endoftext|>another text", " <|endoftext|>", "<|endoftext|> a  b\n c<|endoftext|>", "<|endof text|> plain", "no token"]
    assert 50256 in library.encode(texts[0], add_special_tokens=False).ids
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, dac.op10_token_files(spark, str(tmp_path)).collect())) == sorted(expected(list(enumerate(texts)), library))


def test_texts_together(library, made):
    texts = ["see the zorblat, zorblat.\nand é zorblat", None, "", "the<|endoftext|> zorblat", " the  zorblat \n\n", "a\nb\n"] * 3
    ids = [library.encode(x or "", add_special_tokens=False).ids for x in texts]
    for own in made.values():
        flat, sizes = own.many(texts)
        assert sizes.tolist() == [*map(len, ids)] and flat.tolist() == [i for x in ids for i in x]
    assert not any("," in x or "." in x for x in made[public_tokenizers.PATTERN].pieces.pieces)
