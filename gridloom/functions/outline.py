"""Pages that differ only in the texts of cells, titles and links are laid out once.

A page is cut into its outline and its texts: runs of text that end a cell, first heading or title, linked or not. What
the outline fixes (classes, layout, header names) is found once, with a mark in the place of each text; for each page
only the types of its cells are then looked up. Where texts could change more than a type, the page is read whole."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from . import dom, grid, scalars

#: Columns of a page's rows that no text changes but by the types of body cells.
TEXTLESS = frozenset(("page_id", "ord", "number", "html_class", "kind", "nrows", "ncols", "start_rows", "headers"))
#: Bounds on what a worker remembers: characters of outlines (a laid-out cell counts as 20), outlines seen once, rows of
#: one outline, types of texts.
MAX_CHARS, MAX_SEEN, MAX_ROWS, MAX_TYPES = 5_000_000, 100_000, 50, 200_000
_TEXT = re.compile(r"""(?:<a()(?: [a-z][a-z-]*="[^"<>&]*")*+>|>)([^<>&\s][^<>&]*+)(?=</(?:a></)?(?:td|h1|title)>)""")
_MARK = "\ue000"
_MARKED = re.compile(rf"<td[^<>]*>(?:<a>{_MARK}(\d+)</a>|{_MARK}(\d+))</td>")


class _Types(dict):
    """The type of each text, as a cell's."""

    def __missing__(self, text: str) -> int | None:
        if len(self) >= MAX_TYPES:
            self.clear()
        found = self[text] = scalars.data_type(text if text.isalnum() else re.sub(r"\s+", " ", text))
        return found


class _Plan:
    """The rows of an outline. ``used``: places of the texts whose types count; ``apart``: groups of texts that must not
    all be equal; ``columns``: for each row, names and body of its columns, places of texts or constant types."""

    def __init__(self, pieces: tuple, linked: tuple, names: list[str], read: Callable) -> None:
        marked = "".join(p for i, piece in enumerate(pieces) for p in (piece, "" if i == len(linked) else f"{'>' if linked[i] is None else '<a>'}{_MARK}{i}"))
        if any(_MARK in p for p in pieces) or dom._quick(marked) is None:
            raise ValueError("outline of markup that is not plain")
        laid = bool({"number", "ord", "kind", "nrows", "ncols", "start_rows", "headers"} & set(names))
        headed = "headers" in names
        self.rows = list(read(None, marked, [*names, *(["matrix"] if laid else []), *(["start_rows"] if headed else [])]))
        self.apart: list[tuple[int, ...]] = []
        self.columns: list[list[tuple[str, list]]] = []
        used: dict[int, int] = {}
        for i, row in enumerate(self.rows):
            start, headers, matrix = row[9], row[10], row[12]
            places = [[self._place(c) for c in line] for line in matrix or []]
            if places and len(last := {p for p in places[-1] if p is not None}) > 1 and None not in places[-1]:
                self.apart.append(tuple(sorted(last)))
            if any(p is not None for line in places[:start] for p in line):
                raise ValueError("texts in headers")
            columns = []
            for c, header in enumerate(headers):
                body = [(used.setdefault(p, len(used)), None) if (p := places[r][c]) is not None else (None, scalars.data_type(grid.cell(matrix[r][c]).type_text)) for r in range(start, len(matrix))]
                columns.append((header.rpartition("@")[0], body))
            self.columns.append(columns)
            self.rows[i] = (*row[:12], None, *row[13:])
        self.used = tuple(used)
        self.made: dict[tuple, list[tuple]] = {}

    @staticmethod
    def _place(markup: str) -> int | None:
        """Which text a cell is made of; None if of none."""
        if _MARK not in markup:
            return None
        found = _MARKED.fullmatch(markup)
        if found is None:
            raise ValueError("text inside other markup")
        return int(found[1] or found[2])

    def of(self, texts: list[str], types: _Types) -> list[tuple] | None:
        """The rows of a page of these texts, without its id; None if it must be read whole."""
        for group in self.apart:
            first = texts[group[0]]
            if all(texts[i] == first for i in group):
                return None
        kinds = tuple([types[texts[i]] for i in self.used])
        found = self.made.get(kinds)
        if found is None:
            if len(self.made) >= MAX_ROWS:
                self.made.clear()
            found = self.made[kinds] = [
                (*row[:10], [f"{name}@{grid.most_frequent([kind if at is None else kinds[at] for at, kind in body])}" for name, body in columns], *row[11:])
                for row, columns in zip(self.rows, self.columns, strict=True)
            ]
        return found


class Reader:
    """Reads pages as ``read(page_id, markup, names)`` does, if names are all in ``TEXTLESS``."""

    def __init__(self, names: list[str], read: Callable[..., Iterator[tuple]]) -> None:
        self.names, self.read, self.types, self.left = names, read, _Types(), MAX_CHARS
        self.seen: set[int] = set()
        self.plans: dict[tuple, _Plan | None] = {}

    def __call__(self, page_id: int | None, markup: str | None, _=None) -> list[tuple] | Iterator[tuple]:
        parts = _TEXT.split(markup or "")
        key = (*parts[::3], *parts[1::3])
        plan = self.plans.get(key)
        if plan is None:
            plan = self._planned(key, len(parts) // 3)
        rows = plan.of(parts[2::3], self.types) if plan is not None else None
        return self.read(page_id, markup, self.names) if rows is None else [(page_id, *r[1:]) for r in rows]

    def _planned(self, key: tuple, n: int) -> _Plan | None:
        """The plan of an outline that is seen again, if it has one."""
        if key in self.plans:
            return None
        if (short := hash(key)) not in self.seen:
            if len(self.seen) >= MAX_SEEN:
                self.seen.clear()
            self.seen.add(short)
            return None
        pieces = key[: n + 1]
        try:
            plan = _Plan(pieces, key[n + 1 :], self.names, self.read)
        except (ValueError, RecursionError, IndexError):
            plan = None
        self.left -= sum(map(len, pieces)) + (20 * sum(len(body) for row in plan.columns for _, body in row) if plan is not None else 0)
        if self.left < 0:
            self.plans.clear()
            self.left = MAX_CHARS
        self.plans[key] = plan
        return plan
