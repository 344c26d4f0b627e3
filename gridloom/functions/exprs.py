"""Text functions as column expressions, for Catalyst."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import BLANKED, SPELLED

#: Words left out of headers, and the address of articles.
STOP_WORDS = ["the", "of", "by", "in", "on", "at", "for", "an"]
WIKI_BASE = "https://en.wikipedia.org/wiki"


def remove_stop_words(text: Column) -> Column:
    return F.array_join(F.filter(F.split(F.replace(text, F.lit("_"), F.lit(" ")), " ", -1), lambda w: ~w.isin(STOP_WORDS)), " ")


def spell_symbols(text: Column) -> Column:
    """Symbols spelled out or blanked, spaces to underscores; an ``n__`` prefix stays."""
    parts = F.split(text, "__", -1)
    numbered = F.size(parts) > 1
    rest = F.replace(F.when(numbered, F.element_at(parts, 2)).otherwise(text), F.lit("_"), F.lit(" "))
    for symbol, word in SPELLED.items():
        rest = F.trim(F.replace(rest, F.lit(symbol), F.lit(word)))
    for symbol in BLANKED:
        rest = F.trim(F.replace(rest, F.lit(symbol), F.lit(" ")))
    rest = F.replace(F.trim(F.regexp_replace(rest, r"\s+", " ")), F.lit(" "), F.lit("_"))
    return F.concat(F.when(numbered, F.concat(F.element_at(parts, 1), F.lit("__"))).otherwise(""), rest)


def header_token(text: Column) -> Column:
    """A header as a token: lower case, no ending punctuation, no digits, underscores for spaces."""
    bare = F.regexp_replace(F.trim(F.lower(text)), "[:,.]+$", "")
    bare = F.trim(F.regexp_replace(F.replace(bare, F.lit("&"), F.lit("and")), "[0-9]+", ""))
    return F.regexp_replace(bare, r"\s+", "_")


def order_headers(headers: DataFrame, keys: list[str], name: str = "header", pos: str = "pos") -> DataFrame:
    """Names that occur more than once in a table get their number in front, in order of position."""
    own = Window.partitionBy(*keys, name)
    n, k = F.count("*").over(own), F.row_number().over(own.orderBy(pos))
    return headers.withColumn("ordered", F.when(n > 1, F.concat_ws("__", k, F.col(name))).otherwise(F.col(name)))


def grams(text: Column, k: int = 3) -> Column:
    """The different k-character runs of a text."""
    n = F.length(text) - (k - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column, k: int = 3) -> Column:
    """Sorensen-Dice similarity of the k-character runs; one for equal texts."""
    x, y = grams(a, k), grams(b, k)
    total = F.size(x) + F.size(y)
    return F.when(a == b, 1.0).when(total > 0, 2 * F.size(F.array_intersect(x, y)) / total).otherwise(0.0)


def wiki_link(link: Column) -> Column:
    """A link in a page as a full article address; "" if it is none."""
    bare = F.replace(F.replace(link, F.lit('"'), F.lit("")), F.lit("''"), F.lit(""))
    cut = F.substring_index(F.substring_index(bare, "#", 1), "%23", 1)
    inner = F.when(cut.startswith("."), F.replace(cut, F.lit("."), F.lit(""))).otherwise(cut)
    inner = F.when(inner.startswith("/"), F.replace(inner, F.lit("//"), F.lit("/"))).otherwise(inner)
    path = F.replace(inner, F.lit(" "), F.lit("_"))
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    quoted = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    for code, char in (("%2F", "/"), ("%3A", ":"), ("%2C", ","), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        quoted = F.replace(quoted, F.lit(code), F.lit(char))
    quoted = F.replace(quoted, F.lit("*"), F.lit("%2A"))
    full = F.concat(F.lit(WIKI_BASE), quoted)
    skipped = link.contains("cite_note") | bare.contains("index.php") | bare.contains("File:")
    return (
        F.when(skipped, "").when(cut.startswith("http"), F.when(cut.contains("wikipedia"), cut).otherwise(""))
        .when(inner == "", "").when(inner.contains("%"), F.concat(F.lit(WIKI_BASE), inner))
        .when(full.endswith("/wiki"), "").otherwise(full)
    )


def title_bag(*texts: Column) -> Column:
    """The different words of several texts, by first occurrence."""
    return F.array_distinct(F.filter(F.split(F.concat_ws(" ", *texts), r"\s+", -1), lambda w: w != ""))


def set_up_text(word: Column) -> Column:
    """Four digits of a year become ``yearheader``, other digits but four ``numberheader``."""
    year = word.rlike("^[0-9]{4}$") & word.try_cast("int").between(1500, 2100)
    return F.when(year, "yearheader").when(word.rlike("^[0-9]{4}$"), word).when(word.rlike("^[0-9]+$"), "numberheader").otherwise(word)


def clean_words(text: Column) -> Column:
    """Header text without type, number and level marks; punctuation blanked, numbers dropped."""
    bare = F.regexp_replace(F.regexp_replace(text, "@.*$", ""), "^[0-9]+__", "")
    words = F.split(F.regexp_replace(F.replace(bare, F.lit("**"), F.lit(" ")), r"[^A-Za-z0-9]+", " "), " ", -1)
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]+$")), " ")


def udfs() -> dict:
    """The functions without a built-in form, as Arrow-backed UDFs. Deduplicate their inputs first."""
    from . import scalars

    text = F.pandas_udf

    def stem_words(s: pd.Series) -> pd.Series:
        return s.map(scalars.stem_words, na_action="ignore")

    def clean_header(s: pd.Series) -> pd.Series:
        return s.map(scalars.clean_header, na_action="ignore")

    def data_type(s: pd.Series) -> pd.Series:
        return s.map(scalars.data_type).astype("Int32")

    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([scalars.similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([scalars.jaro_winkler(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return {
        "stem_words": text(stem_words, "string"),
        "clean_header": text(clean_header, "string"),
        "data_type": text(data_type, "int"),
        "similarity": text(similarity, "double"),
        "jaro_winkler": text(jaro_winkler, "double"),
    }
