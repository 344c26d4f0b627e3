"""Pages read by their outline against pages read whole, and what is laid out and shuffled."""

import random

import pytest

from gridloom.functions import outline
from gridloom.operators import tables
from gridloom.plans.registry import QUERIES

NAMES = [["page_id", "number", "headers"], ["html_class"], ["page_id", "html_class", "kind"], ["page_id", "ord", "number", "html_class", "kind", "nrows", "ncols", "start_rows", "headers"]]
HEAD = "<tr><th>Port</th><th>Built</th></tr>"
#: Markup with places for texts.
ODD = [
    f"<h1>{{}}</h1><table>{HEAD}<tr><td>{{}}</td><td>{{}}</td></tr><tr><td>{{}}</td><td><a href='x'>{{}}</a></td></tr></table>",
    f'<title>{{}}</title><table class="w">{HEAD}<tr><td rowspan="2"><a href="./{{}}">{{}}</a></td><td>{{}}</td></tr><tr><td>{{}}</td></tr></table>',
    f'<table>{HEAD}<tr><td>{{}}</td><td>{{}}</td></tr><tr><td colspan="2">{{}}</td></tr></table><table><tr><td>{{}}</td><td>{{}}</td></tr></table>',
    "<table><tr><td>{}</td></tr><tr><td>{}</td><td>{}</td></tr><tr><th>{}</th><th>b</th></tr><tr><td>{}</td><td>{}</td></tr></table>",
    f"<table>{HEAD}<tr><td>x<td>{{}}</td></td><td><b>{{}}</td></tr><tr><td>{{}} >{{}}</td><td><a>{{}}</td></tr></table>",
    f"<table>{HEAD}<tr><td>{{}}</td><td><table><tr><th>k</th><td>{{}}</td></tr><tr><td>{{}}</td><td>{{}}</td></tr></table></td></tr></table><!-- <td>{{}}</td> -->",
    '<table class="toc"><tr><td>{}</td></tr></table><table><caption>{}</caption><tr><td><b>{}</b></td><td><b>n</b></td></tr><tr><td>{}</td><td>{}</td></tr></table>',
]
TEXTS = ["12", "1999", "7", "2001-05-06", "Oslo", "may 5", "3 x", " ", "", "a\xa0 b", "é", "x &amp; y", "\ue000", "\x1fq", "[4]", "same", "same"]


def rows_of(found, names):
    return [[r[tables._ARROW.names.index(c)] for c in names] for r in found]


@pytest.mark.parametrize("names", NAMES)
def test_like_pages_read_whole(names):
    rng = random.Random(5)
    tags = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", '<td colspan="2">', '<td rowspan="2">', "<th>", "</th>", '<a href="q">', "</a>", "<b>", "</b>", "h", ">", "\n", "<h1>", "</h1>"]
    soup = ["<table><tr>" + "".join(rng.choice(tags) if rng.random() < 0.5 else "<td>{}</td>" for _ in range(rng.randrange(14))) for _ in range(300)]
    read = outline.Reader(names, tables.read_page)
    for markup in ODD + soup:
        for i in range(8):
            page = markup.format(*(rng.choice(TEXTS[:7] if i < 5 else TEXTS) for _ in range(markup.count("{}"))))
            assert rows_of(read(i, page), names) == rows_of(tables.read_page(i, page, names), names), page
    assert rows_of(read(1, None), names) == []
    assert sum(p is not None for p in read.plans.values()) > 50


def test_equal_texts_in_a_last_row():
    """A row of equal cells is taken off, so such a page has another layout than its outline."""
    page = f"<table>{HEAD}<tr><td>{{}}</td><td>{{}}</td></tr><tr><td>{{}}</td><td>{{}}</td></tr></table>".format
    read = outline.Reader(NAMES[0], tables.read_page)
    texts = [("1", "a", "x", "1999"), ("1", "b", "2", "y"), ("x", "1", "y", "y"), ("x", "1", "7", "y")]
    assert [rows_of(read(0, page(*t)), ["headers"]) for t in texts] == [[[["port@3", "built@2"]]], [[["port@1", "built@3"]]], [[["port@3", "built@1"]]], [[["port@1", "built@3"]]]]


def test_pages_of_one_outline_are_laid_out_twice():
    calls = []

    def read(*args):
        calls.append(args)
        return tables.read_page(*args)

    reader = outline.Reader(NAMES[0], read)
    for i in range(50):
        page = f'<h1>Order {i}</h1><table>{HEAD}<tr><td><a href="./S{i}">S{i}</a></td><td>{i}</td></tr><tr><td>O{i}</td><td>{i}</td></tr></table>'
        assert rows_of(reader(i, page), NAMES[0]) == rows_of(tables.read_page(i, page, NAMES[0]), NAMES[0])
    assert len(calls) == 2


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(outline, "MAX_CHARS", 2_000)
    monkeypatch.setattr(outline, "MAX_ROWS", 3)
    monkeypatch.setattr(outline, "MAX_TYPES", 5)
    monkeypatch.setattr(outline, "MAX_SEEN", 20)
    reader = outline.Reader(NAMES[0], tables.read_page)
    for i in range(300):
        page = f"<p>{i % 40 // 2}<table>{HEAD}" + "".join(f"<tr><td>{i * k}</td><td>{'xy'[i * k % 2]}{k}</td></tr>" for k in range(4)) + "</table>"
        assert rows_of(reader(i, page), NAMES[0]) == rows_of(tables.read_page(i, page, NAMES[0]), NAMES[0])
    assert len(reader.plans) < 15 and len(reader.seen) <= 20 and len(reader.types) <= 5 and all(len(p.made) <= 3 for p in reader.plans.values() if p)


def test_pages_take_two_shuffles(spark, sf_dir):
    """Lines and orders meet by order; types are counted where the page was read."""
    plan = QUERIES["table_type_counts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("MapInArrow") == 1


def test_type_counts(spark):
    found = spark.createDataFrame([("a", ["x@1", "y@3", "z@3"]), ("b", ["spancol@2", "spancol@4"]), ("c", ["spancol@2", "q@u@4"])], "table_id string, headers array<string>")
    assert sorted(map(tuple, tables.type_counts(found).collect())) == [("a", 1, 0, 2, 0), ("c", 0, 1, 0, 1)]
