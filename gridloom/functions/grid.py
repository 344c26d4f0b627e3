"""HTML tables as grids: which tables count, how spans spread, where headers are.

A page's tables go through :func:`page_tables`. Every table has a class by its markup (:func:`classify`) and, once
laid out, a type by its shape. Failures are types too; nothing raises.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

from . import dom, scalars
from .dom import Tag

# Class names and limits that results depend on.
INFOBOX, FORMAT_BOX, TOC, WIKITABLE, SMALL, NO_CLASS = "INFOBOX", "FORMAT_BOX", "TOC", "WIKITABLE", "SMALL_TABLE", "NO_CSS_CLASS"
INNER, WITH_INNER, WELL_FORMED, ILL_FORMED = "INNER_TABLE", "WITH_INNER_TABLE", "WELL_FORMED", "ILL_FORMED"
BOX_WORDS = ("box", "metadata", "maptable", "vcard", "navbox")
NAVIGATION = ("navbox", "navgroup")
MAX_SPAN, MAX_INNER, MAX_HEADER, MAX_LINKED = 100, 10, 1000, 3000
KEPT_ATTRS = ("th", "td", "a", "abbr")
EMPTY = "<td></td>"


class Broken(Exception):
    """A table that cannot be laid out, and the type that it gets."""

    def __init__(self, kind: str) -> None:
        super().__init__(kind)
        self.kind = kind


@dataclass
class Grid:
    """A table laid out; ``matrix`` is None where it could not be."""

    kind: str
    title: str = ""
    matrix: list[list[str]] | None = None
    nrows: int = 0
    html: str = ""
    attrs: dict[str, str] = field(default_factory=dict)


def cells(row: Tag) -> list[Tag]:
    return [c for c in row.children if c.__class__ is not str and (c.name == "td" or c.name == "th")]


def _navigates(cell: Tag) -> bool:
    if not cell.attrs.get("class"):
        return False
    name = " ".join(cell.classes)
    return any(word in name for word in NAVIGATION)


def navigation_cell(table: Tag, rows: list[list[Tag]] | None = None) -> bool:
    return any(_navigates(c) for row in (map(cells, table.tags("tr")) if rows is None else rows) for c in row if c.attrs)


def small(rows: list[list[Tag]]) -> bool:
    """Fewer than two rows, or no row of two cells."""
    return len(rows) < 2 or all(len(r) < 2 for r in rows)


@lru_cache(maxsize=10_000)
def _marks(name: str) -> tuple[bool, bool, bool]:
    """Whether a class attribute marks an infobox, another box, a table of contents."""
    names = re.sub(r"\W+", " ", " ".join(name.split())).lower()
    return "infobox" in names, any(word in names for word in BOX_WORDS), "toc" in names.split()


def classify(table: Tag) -> str:
    """A table's class by where it stands and how it is marked."""
    at = table.parent
    while at is not None:
        if at.name in ("th", "td", "tr"):
            return INNER
        at = at.parent
    marked = "class" in table.attrs
    infobox, box, toc = _marks(table.attrs.get("class") or "")
    if marked and infobox:
        return INFOBOX
    if marked and box:
        return FORMAT_BOX
    inside = list(table.tags("tr", "table"))
    rows = [cells(r) for r in inside if r.name == "tr"]
    if navigation_cell(table, rows):
        return FORMAT_BOX
    if marked and toc:
        return TOC
    if len(rows) < len(inside):
        return WITH_INNER
    return SMALL if small(rows) else WIKITABLE if marked else NO_CLASS


def _attrs(tag: Tag) -> dict[str, str]:
    """The attributes that a grid's cells keep."""
    if not tag.attrs or tag.name not in KEPT_ATTRS:
        return {}
    if "id" not in tag.attrs or tag.name not in ("td", "th"):
        return tag.attrs
    return {k: v for k, v in tag.attrs.items() if k != "id"}


def _span(cell: Tag, name: str) -> int | None:
    """A span as a number; None where the attribute is blank; one where it is missing."""
    value = cell.attrs.get(name) if cell.attrs else None
    if value is None:
        return 1
    if value == "":
        return None
    try:
        return int(value)
    except ValueError:
        raise Broken(ILL_FORMED) from None


def _width(rows: list[list[Tag]]) -> tuple[int, str]:
    """Columns that the rows need, and the title if the first row is one cell wide.

    The last cell of a row counts as one column; spans that reach down count in the rows that they reach."""
    width, pending, title = 0, [], ""
    for r, own in enumerate(rows):
        wide = 0
        for cell in own[:-1]:
            if _navigates(cell):
                raise Broken(FORMAT_BOX)
            span = _span(cell, "colspan")
            if span is not None and span >= MAX_SPAN:
                raise Broken(ILL_FORMED)
            wide += 0 if span is None else span or 1
        width = max(width, wide + bool(own) + len(pending))
        deep = [1 if (s := _span(c, "rowspan")) is None else s or len(rows) - r for c in own]
        pending = [s - 1 for s in [*pending, *deep] if s > 1]
        if r == 0 and width == 1:
            title = own[0].text if own else ""
    return width, title


def _spread(rows: list[list[Tag]], width: int) -> list[list[str]]:
    """Every cell's HTML in each place that it spans.

    Only the first column of a cell that spans rows is taken in the rows below."""
    out = [[EMPTY] * width for _ in rows]
    taken: dict[int, int] = {}  # column: rows it is still taken for, this one included
    for r, row in enumerate(rows):
        at = 0
        for cell in row:
            while taken.get(at, 0):
                at += 1
            down, across = _span(cell, "rowspan"), _span(cell, "colspan")
            if across is not None and across >= MAX_SPAN:
                raise Broken(ILL_FORMED)
            down = 1 if down is None else down or len(rows) - r
            across = 1 if across is None else across or width - at
            body = cell.html(_attrs)
            if down == across == 1 and at < width:
                out[r][at] = body
            else:
                for y in range(r, min(r + down, len(rows))):
                    for x in range(at, min(at + across, width)):
                        out[y][x] = body
            taken[at] = down
            at += across
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
    return out


def lay_out(table: Tag, owner: Tag | None = None) -> Grid:
    """A table without inner tables as a grid. ``owner`` is the table whose caption counts."""
    try:
        rows = [cells(r) for r in table.tags("tr")]
        width, title = _width(rows)
        if title:
            rows = rows[1:]
        elif (caption := (owner or table).first("caption")) is not None:
            title = caption.text
        if width <= 0:
            raise Broken(ILL_FORMED)
        matrix = _spread(rows, width)
        if len(matrix) >= 2 and width > 1 and len(set(matrix[-1])) == 1:
            matrix.pop()
        kind = SMALL if len(matrix) < 2 or width < 2 else WELL_FORMED
        return Grid(kind, title, matrix, len(matrix), "", dict((owner or table).attrs))
    except Broken as broken:
        return raw(table, broken.kind)


def raw(table: Tag, kind: str) -> Grid:
    """A table kept as it is."""
    rows = list(table.tags("tr"))
    only = list(rows[0].tags("td", "th")) if rows else []
    return Grid(kind, only[0].text if len(only) == 1 else "", None, len(rows), table.html(lambda t: t.attrs if t is table else _attrs(t)))


def _leaves(table: Tag) -> list[Tag] | None:
    """Innermost tables; None if there are more than ``MAX_INNER``."""
    found = [t for t in table.tags("table") if t.first("table") is None]
    return found if len(found) <= MAX_INNER else None


def _separable(table: Tag, inner: list[Tag]) -> bool:
    """Whether inner tables stand for themselves: each has a header or is a legend of one column, and the outer table
    has no more headers than there are inner ones."""
    body = table if table.direct("tr") else next(iter(table.direct("tbody")), None)
    if body is None:
        return False
    if len([1 for row in body.direct("tr") for c in row.direct("th") if c.text]) > len(inner):
        return False

    def stands(t: Tag) -> bool:
        rows = list(t.tags("tr"))
        header = any(row.direct("th") or any(c.first("b") for c in row.direct("td")) for row in rows)
        return header or bool(rows) and len(rows[0].direct("td")) == 1

    return all(map(stands, inner))


def grids(table: Tag) -> list[Grid]:
    """The grids of one outer table: itself, or its inner tables where these stand for themselves."""
    if table.first("table") is None:
        return [lay_out(table)]
    inner = _leaves(table)
    if inner is not None and _separable(table, inner):
        return [lay_out(t, None) for t in inner]
    if inner is None:
        return [raw(table, WITH_INNER)] if table.first("tr") else []
    kind = FORMAT_BOX if navigation_cell(table) else WITH_INNER
    return [raw(table, kind)] if table.first("tr") else []


def _hidden(tag: Tag) -> bool:
    return tag.name == "sup" or tag.name == "span" and "sortkey" in " ".join(tag.classes)


def _unlinked(tag: Tag) -> bool:
    name = " ".join(tag.classes)
    return tag.name == "a" or tag.name in ("span", "sup") and ("sortkey" in name or "reference" in name)


def _joined(tag: Tag) -> str:
    return " ".join(s for s in tag.strings() if s.strip("\n "))


class Cell(NamedTuple):
    """What is read from one cell's HTML."""

    header: str | None
    raw_text: str
    text: str
    type_text: str
    colspan: int
    links: tuple[str, ...]
    is_th: bool
    bullets: int
    formats: int
    breaks: int
    n_links: int
    has_span: bool
    free_text: int
    length: int


_RUN = re.compile(r"""<(td|th)((?: [a-z][a-z-]*="[^"'<>&]*")*)>(?:(<a)((?: [a-z][a-z-]*="[^"'<>&]*")*)>)?([^<>&]*)(?(3)</a>)</\1>""")
_HREF = re.compile(r' href="([^"]*)"')


@lru_cache(maxsize=10_000)
def _spanned(attrs: str) -> tuple[int, bool]:
    """A cell's colspan and whether it has spans, from its attributes as written."""
    own = dom.parse(f"<td{attrs}></td>").children[0].attrs
    try:
        wide = int(own.get("colspan", 1))
    except ValueError:
        wide = 1
    return wide, "colspan" in own or "rowspan" in own


def _run(markup: str) -> Cell | None:
    """The facts of a cell that holds one run of text, linked as a whole or not at all; None for other cells."""
    found = _RUN.fullmatch(markup)
    if found is None:
        return None
    name, attrs, link, linked, written = found.groups()
    wide, spans = _spanned(attrs)
    raw = written if written.strip("\n ") else ""
    kind = raw if raw.isalnum() else re.sub(r"\s+", " ", raw)
    text = kind.strip()
    href = (_HREF.search(linked) or (None, None))[1] if link else None
    own = text if raw else re.sub(r"\s+", " ", written).strip()
    free = "" if link else own
    head = name == "th"
    return Cell(
        header=own if head and len(own) <= MAX_HEADER else None, raw_text=raw, text=text, type_text=kind, colspan=wide,
        links=(href,) if href is not None and len(markup) <= MAX_LINKED else (), is_th=head, bullets=0, formats=int(head), breaks=0,
        n_links=int(href is not None), has_span=spans, free_text=len(free), length=9 + (0 if link else len(written)),
    )


@lru_cache(maxsize=100_000)
def cell(markup: str) -> Cell:
    """The facts of a cell, from its HTML."""
    return _run(markup) or _read(markup)


def _read(markup: str) -> Cell:
    """The facts of any cell, from its tree."""
    root = dom.parse(markup)
    shown = root.without(_hidden) if "<s" in markup.lower() else root
    box = root.first("th") or root.first("td")
    try:
        wide = int(box.attrs.get("colspan", 1)) if box is not None else 1
    except ValueError:
        wide = 1
    body = root.html()
    anchors = [a for a in root.tags("a") if "href" in a.attrs]
    count = lambda *names: len(list(root.tags(*names)))
    rest = root.without(_unlinked)
    return Cell(
        header=header_text(markup, root),
        raw_text=_joined(shown),
        text=re.sub(r"\s+", " ", _joined(shown)).strip(),
        type_text=re.sub(r"\s+", " ", _joined(root)),
        colspan=wide,
        links=tuple(a.attrs["href"] for a in anchors) if len(body) <= MAX_LINKED else (),
        is_th=root.first("th") is not None,
        bullets=count("ul", "ol"),
        formats=count("font", "b", "i", "th", "small"),
        breaks=count("br"),
        n_links=len(anchors),
        has_span=box is not None and ("colspan" in box.attrs or "rowspan" in box.attrs),
        free_text=len(re.sub(r"\s+", " ", rest.text).strip()),
        length=len(rest.html(lambda _: {})),
    )


def header_text(markup: str, root: Tag | None = None) -> str | None:
    """The header that a cell holds: "" for an empty one, None for none. ``root`` is its tree where known."""
    if root is None or "\n" in markup or "<br" in markup:
        root = dom.parse(re.sub(r"<br/*?\s*?>", " ", markup).replace("\n", " "))
    short = root.first("abbr")
    spelled = None if short is None else short.attrs.get("title", "").strip()
    head = root.first("th")
    if head is not None:
        text = re.sub(r"\s+", " ", head.text).strip()
        if len(text) > MAX_HEADER:
            return spelled
        if spelled is not None and text == text.upper():
            return spelled
        return text
    bold = root.first("b")
    if bold is not None:
        text = bold.text.replace("\t", " ").strip()
        return text if len(text) <= MAX_HEADER else None
    return None if short is None or "title" not in short.attrs else spelled


def header_rows(matrix: list[list[str]]) -> tuple[int, list[str]]:
    """How many rows are header, and the texts of the last of them.

    Rows are read while they hold headers: blank rows and rows of empty headers are passed over, a row that is header
    all across without spans ends the search, and a row with other text ends it before that row."""
    width = len(matrix[0])
    texts = lambda r: [cell(c).text for c in matrix[r]]
    seen = False
    for r, row in enumerate(matrix):
        found = [h for c in row if (h := cell(c).header) is not None]
        if found and set(found) == {""}:
            continue
        if found:
            seen = True
            if len(found) == width:
                if sum(cell(c).colspan for c in row) == width:
                    return r + 1, found
                continue
            if not any(texts(r)):
                continue
        elif not seen and not any(texts(r)):
            continue
        if not seen:
            return 0, []
        return (r, texts(r - 1)) if r else (1, texts(0))
    return (1, texts(0)) if seen else (0, [])


def most_frequent(kinds: Iterable[int | None]) -> int:
    """The most frequent type; of equals the one seen first last; other if there is none."""
    counts: dict[int, int] = {}
    for kind in kinds:
        if kind is not None:
            counts[kind] = counts.get(kind, 0) + 1
    most = max(counts.values(), default=0)
    return next((k for k in reversed(counts) if counts[k] == most), scalars.OTHER)


def column_type(matrix: list[list[str]], start: int, column: int) -> int:
    """The most frequent type of a column's body."""
    return most_frequent(scalars.data_type(cell(row[column]).type_text) for row in matrix[start:])


def column_headers(matrix: list[list[str]], start: int) -> list[str]:
    """One name for each column from all header rows, with its type: ``upper**lower@3``."""
    if not start:
        return []
    levels = [[scalars.clean_header(re.sub(r"[*@]", "", cell(c).raw_text)) for c in row] for row in matrix[:start]]
    levels[-1] = [h or "spancol" for h in levels[-1]]
    names = [re.sub(r"^\*+", "", "**".join(parts)) for parts in zip(*levels, strict=True)]
    if start > 1:
        names = [n.removesuffix("**") for n in names]
    return [f"{n}@{column_type(matrix, start, i)}" for i, n in enumerate(scalars.order_headers(names))]


def row_headers(matrix: list[list[str]], start: int, column: int = 0) -> list[str]:
    """The headers in one column of the body, as names; none if all are empty."""
    found = [h for row in matrix[start:] if (h := cell(row[column]).header) is not None]
    if set(found) == {""}:
        return []
    return [h.lower().strip().replace(" ", "_") if h else "spancol" for h in found]


def page_title(root: Tag) -> str:
    """The first heading of class firstHeading, or the title."""
    heading = next((h for h in root.tags("h1") if "firstHeading" in h.classes), None)
    title = root.first("title")
    return heading.text if heading is not None else title.text if title is not None else ""
