"""Cutting a text at its single spaces, so that an encoder sees each distinct piece once.

Texts are taken in groups: Arrow numbers the pieces of a group, and each different one is looked up once.

A pre-token of byte-level BPE has white space at its start only, unless it is a run of white space. So a space with
no other white space beside it always begins a pre-token, and what stands before it can be encoded apart from what
follows. Texts in which a space stands beside other white space are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes that a generation of remembered strings may hold; this bounds memory and changes no result.
BUDGET = 40_000_000
#: What an entry costs besides its key and value, and the longest key in code points that is remembered.
ENTRY, LONGEST = 110, 64
#: Bytes of texts whose pieces are numbered together; a longer text is taken alone.
TOGETHER = 3_000_000
_ENDS = frozenset(",.")
_WHITE = [c for c in map(chr, range(0x3001)) if regex.match(r"\s", c) or c.isspace()]


def plain(text: str) -> bool:
    """Whether no space of the text stands beside other white space."""
    return not any(c in text and (c + " " in text or " " + c in text) for c in _WHITE)


def apart_lines(text: str) -> str:
    """A plain text with a space before each line feed, if none stands beside white space and there is no other: a line
    feed between other characters is a pre-token, and so is one at the end. No piece of a plain text begins with one."""
    return text if "\n\n" in text or any(c in text for c in _WHITE if c not in " \n") else text.replace("\n", " \n")


class Remembered(dict):
    """string -> bytes, made as it is asked for. Two generations of ``budget`` bytes each: a full one becomes the older
    one, and what is asked for again moves back, so that frequent strings stay. Long strings are made each time."""

    def __init__(self, make: Callable[[str], bytes], budget: int = BUDGET) -> None:
        super().__init__()
        self.make, self.budget, self.older, self.held = make, budget, {}, 0

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONGEST:
            self[key] = found
            self.held += ENTRY + getsizeof(key) + getsizeof(found)
            if self.held > self.budget:
                self.older, self.held = dict(self), 0
                self.clear()
        return found


class Words(Remembered):
    """Pieces as they stand after a space. Those of letters alone, which are one pre-token with the space, are
    remembered; the others are made each time of their parts, so that a word is held once, whatever stands behind it."""

    def __init__(self, encode: Callable[[str], bytes], parts: Callable[[str], bytes], budget: int = BUDGET) -> None:
        super().__init__(lambda piece: encode(" " + piece), budget)
        self.parts = parts

    def __missing__(self, key: str) -> bytes:
        return Remembered.__missing__(self, key) if key.isalpha() else self.parts(key)


class Pieces:
    """Packed ids of texts (four bytes each, little-endian) from an encoder of single pre-tokens.

    find: the pre-tokens of a text; encode: the packed ids of one. Letters after a space are remembered without it; the
    other pre-tokens are remembered apart."""

    def __init__(self, find: Callable[[str], list[str]], encode: Callable[[str], bytes], budget: int = BUDGET) -> None:
        self.find, self.encode = find, encode
        self.tokens, self.pieces = Remembered(encode, budget // 4), Words(encode, self._parts, budget)

    def _parts(self, piece: str) -> bytes:
        """A piece that is not letters alone; most often it is letters and a comma or full stop, two pre-tokens."""
        if piece[-1:] in _ENDS and (word := piece[:-1]).isalpha():
            return self.pieces[word] + self.tokens[piece[-1]]
        if piece[:1] == "\n":  # see apart_lines
            return self.tokens["\n"] + self.tokens[piece[1:]] if piece[1:].isalpha() else self.whole(piece)
        return self.whole(" " + piece)

    def after_space(self, token: str) -> bytes:
        return self.pieces[token[1:]] if token[0] == " " and token[1:].isalpha() else self.tokens[token]

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.after_space, self.find(text)))

    def ids(self, text: str | None) -> bytes:
        """The ids of a text; none for null."""
        return self.many([text])[0].tobytes()

    def many(self, texts: list[str | None], apart: Callable[[str], bytes | None] = lambda text: None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and how many each has; none for null. ``apart`` may give the ids of a
        text that is not to be cut at all; such a text, and one that is not plain, is one empty piece with all its ids."""
        own = [apart(x) if x else b"" for x in texts]
        own = [self.whole(x) if o is None and not plain(x) else o for x, o in zip(texts, own, strict=True)]
        cut = pc.split_pattern(pa.array([apart_lines(x) if o is None else "" for x, o in zip(texts, own, strict=True)], pa.large_string()), " ")
        edges, named = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        first = cut.values.take(pa.array(edges[:-1])).to_pylist()  # no space stands before it
        found = [*map(self.pieces.__getitem__, _listed(named.dictionary)), *(self.whole(f) if o is None else o for f, o in zip(first, own, strict=True))]
        which = named.indices.to_numpy().copy()
        which[edges[:-1]] = np.arange(len(found) - len(texts), len(found))
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        starts, counts = np.cumsum(sizes) - sizes, sizes[which]
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        places = np.repeat((starts[which] - ends[:-1]).astype(np.int32), counts)
        places += np.arange(len(places), dtype=np.int32)
        return np.frombuffer(b"".join(found), "<i4")[places], np.diff(ends[edges])


def together(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of one row or of at most ``TOGETHER`` bytes in its column of texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _listed(pieces: pa.Array) -> list[str]:
    """The strings of an array in which no string has a space, faster than ``to_pylist``."""
    if not len(pieces):
        return []
    together = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
    return pc.binary_join(together, pa.scalar(" ", pieces.type))[0].as_py().split(" ")
