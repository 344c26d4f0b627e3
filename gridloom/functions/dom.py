"""A small, tolerant HTML tree on the standard library's parser.

Void elements have no children; an end tag closes up to the nearest open tag of its name and is ignored if there is
none; nothing is closed implicitly. Attribute ``class`` is kept as written; comments and declarations are dropped.

Markup of plain tags and text alone is cut at its angle brackets; anything else goes through the library's parser, which
gives the same tree.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

#: Elements without content in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that parsers may read as text; they are left to the library.
TEXT = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
_PLAIN = re.compile(r'(/?)([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"<>&]*")*)')
_SPECIAL = re.compile("[&<>\"']").search
_ATTR = re.compile(r' ([a-z-]+)="([^"]*)"')


class Tag:
    """An element: name, attributes, children (tags and strings) and parent."""

    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, parent: Tag | None = None) -> None:
        self.name, self.attrs, self.parent, self.children = name, attrs or {}, parent, []

    def tags(self, *names: str) -> Iterator[Tag]:
        """Descendant tags of these names (all if none are given), in document order."""
        left = self.children[::-1]
        while left:
            child = left.pop()
            if child.__class__ is str:
                continue
            if not names or child.name in names:
                yield child
            own = child.children
            if own and (len(own) > 1 or own[0].__class__ is not str):
                left += own[::-1]

    def direct(self, *names: str) -> list[Tag]:
        """Child tags of these names."""
        return [c for c in self.children if c.__class__ is not str and c.name in names]

    def first(self, *names: str) -> Tag | None:
        return next(self.tags(*names), None)

    def strings(self) -> Iterator[str]:
        for child in self.children:
            if isinstance(child, Tag):
                yield from child.strings()
            else:
                yield child

    @property
    def text(self) -> str:
        return "".join(self.strings())

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def above(self) -> Iterator[Tag]:
        at = self.parent
        while at is not None:
            yield at
            at = at.parent

    def without(self, drop) -> Tag:
        """A copy that lacks every tag for which ``drop`` holds."""
        copy = Tag(self.name, dict(self.attrs))
        for child in self.children:
            if not isinstance(child, Tag):
                copy.children.append(child)
            elif not drop(child):
                inner = child.without(drop)
                inner.parent = copy
                copy.children.append(inner)
        return copy

    def html(self, attrs=None) -> str:
        """The tag as HTML; ``attrs`` maps a tag to the attributes to write, its own by default."""
        inside = "".join([c.html(attrs) if c.__class__ is not str else c if c.isalnum() else html.escape(c, quote=False) for c in self.children])
        if self.name == "":
            return inside
        written = self.attrs if attrs is None else attrs(self)
        head = "".join([f' {k}="{html.escape(v or "") if _SPECIAL(v or "") else v or ""}"' for k, v in written.items()]) if written else ""
        return f"<{self.name}{head}/>" if self.name in VOID else f"<{self.name}{head}>{inside}</{self.name}>"


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Tag("")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        made = Tag(tag, {}, self.open)
        for k, v in attrs:
            made.attrs.setdefault(k, v or "")
        self.open.children.append(made)
        if tag not in VOID:
            self.open = made

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open = self.open.parent

    def handle_endtag(self, tag: str) -> None:
        at = self.open
        while at is not None and at.name != tag:
            at = at.parent
        if at is not None and at.parent is not None:
            self.open = at.parent

    def handle_data(self, data: str) -> None:
        if self.open.children and isinstance(self.open.children[-1], str):
            self.open.children[-1] += data
        else:
            self.open.children.append(data)


@lru_cache(maxsize=50_000)
def _plain(head: str) -> tuple[str, dict[str, str] | None] | None:
    """Name and attributes of a plain tag, no attributes for an end tag; None if the library has to read it."""
    found = _PLAIN.fullmatch(head)
    if found is None or found[2] in TEXT or found[1] and found[3]:
        return None
    attrs: dict[str, str] = {}
    for k, v in _ATTR.findall(found[3]):
        attrs.setdefault(k, v)
    return found[2], None if found[1] else attrs


def _quick(markup: str) -> Tag | None:
    """The tree of markup of plain tags and text; None for other markup."""
    if "&" in markup:
        return None
    root = now = Tag("")
    pieces = markup.split("<")
    if pieces[0]:
        root.children.append(pieces[0])
    titled = False
    for piece in pieces[1:]:
        head, closed, text = piece.partition(">")
        if not closed:
            return None
        if head in ("title", "/title"):  # text alone may be in it
            if titled is (head == "title"):
                return None
            titled = not titled
            tag = "title", {} if titled else None
        elif titled or (tag := _plain(head)) is None:
            return None
        name, attrs = tag
        if attrs is not None:
            made = Tag(name, attrs, now)
            now.children.append(made)
            if name not in VOID:
                now = made
                if text:
                    made.children.append(text)
                continue
        elif now.name == name:
            now = now.parent
        else:
            at = now
            while at is not None and at.name != name:
                at = at.parent
            if at is not None:
                now = at.parent
        if text:
            own = now.children
            if own and own[-1].__class__ is str:
                own[-1] += text
            else:
                own.append(text)
    return None if titled else root


def parse(markup: str | None) -> Tag:
    """The tree of a page or fragment, under a root without a name; null is empty."""
    root = _quick(markup or "")
    if root is not None:
        return root
    builder = _Builder()
    builder.feed(markup or "")
    builder.close()
    return builder.root
