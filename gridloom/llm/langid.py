"""Language identification by Bayesian evidence fusion.

For a page: P(lang | all) ~ P(text | lang)^TEMPER * P(declared | lang) * P(lang | host).

* Text: a multinomial model over hashed character trigrams of the visible text, with letters lowered and add-one
  counts, trained on labelled documents (at most ``MAX_ROWS``, in the order of a hash of their ids, each read whole).
  TEMPER discounts overlapping trigrams, which are no independent evidence.
* Declared: the language in the ``lang`` attribute of ``<html>``; how often each is declared for each language is
  counted over all pages, softly, by the text's posterior.
* Host: its languages, counted in the same way over all pages but the one at hand, smoothed towards those of its
  domain (two labels), these towards those of the address suffix (one label), and these towards all pages'. Each
  level adds ``STRENGTH`` pseudo-pages of the level above.

All counts are grouped sums, combined before the shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_ROWS, MAX_LANGUAGES = 4_000, 64
BUCKETS, TEMPER, STRENGTH, SPREAD = 1 << 16, 0.1, 4.0, 2.0
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_OTHER = re.compile(r"[\W\d_]+")


def visible(page: str | None) -> str:
    """The text of a page: no comments, scripts, styles or tags, entities resolved."""
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or "")))


def grams(text: str) -> np.ndarray:
    """Bucket numbers of the character trigrams of a text's words."""
    points = np.frombuffer((" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    h = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA77) + points[2:]
    return ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and the log-probability of each bucket in each (BUCKETS x languages). Rows without text
    or language do not count. More than ``MAX_LANGUAGES`` languages are an error."""
    known = docs.select(F.xxhash64(doc_id, text).alias("order"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    keys = known.select("order").orderBy("order").limit(max_rows)
    sample = known.join(F.broadcast(keys.distinct()), "order").select("lang", "text")  # max_rows rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[name] = counts.get(name, 0) + np.bincount(grams(body), minlength=BUCKETS)
        for name, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    summed = sample.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = summed.toPandas()  # BUCKETS rows for each language at most
    names = sorted(rows["lang"].unique())
    if len(names) > MAX_LANGUAGES:
        raise ValueError("too many languages")
    table = np.ones((BUCKETS, max(1, len(names))))
    if names:
        np.add.at(table, (rows["bucket"].to_numpy(), rows["lang"].map(names.index).to_numpy()), rows["n"].to_numpy())
    return names, np.log(table / table.sum(axis=0))


def _host(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def evidence(pages: DataFrame, model: tuple[list[str], np.ndarray], page_id: str, url: str, page: str) -> DataFrame:
    """page_id, host, domain, suffix, declared and ``t``, the text's tempered log-likelihoods."""
    shared = pages.sparkSession.sparkContext.broadcast(model[1])
    schema = f"page_id {pages.schema[page_id].dataType.simpleString()}, host string, declared string, t array<double>"
    declared = F.lower(F.regexp_extract(F.coalesce(page, F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    slim = pages.select(F.col(page_id).alias("page_id"), _host(F.col(url)).alias("host"), declared.alias("declared"), F.col(page).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            scores = [(TEMPER * table[grams(visible(x.as_py()))].sum(axis=0)).tolist() for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.list_(pa.float64()))], names=["page_id", "host", "declared", "t"])

    found = slim.mapInArrow(run, schema)
    return found.withColumns({"domain": F.regexp_extract("host", r"([^.]+\.[^.]+)$|^([^.]*)$", 0), "suffix": F.element_at(F.split("host", r"\."), -1)})


def _softmax(scores: F.Column) -> F.Column:
    powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray], page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, lang (the likeliest; the first by name of equals), p_lang, declared,
    host.

    Null and empty pages have no text evidence, pages without a declaration count as declaring "", and addresses
    without a host share one. Repeated rows count each. With a model of no languages lang is null. An empty table gives
    an empty result. Other columns are not read.
    """
    names = model[0]
    n = len(names)
    if not n:
        return pages.select(F.col(page_id).alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("p_lang"), F.lit("").alias("declared"), _host(F.col(url)).alias("host"))
    rows, _ = common.written(evidence(pages, model, page_id, url, page).withColumn("r", _softmax(F.col("t"))), "langid")
    sums = lambda prefix: [F.sum(F.col("r")[i]).alias(f"{prefix}{i}") for i in range(n)]
    again = lambda prefix, old: [F.sum(f"{old}{i}").alias(f"{prefix}{i}") for i in range(n)]
    pack = lambda prefix: F.array(*(F.coalesce(f"{prefix}{i}", F.lit(0.0)) for i in range(n))).alias(prefix)
    hosts = rows.groupBy("host", "domain", "suffix").agg(*sums("h"))
    hosts, _ = common.written(hosts, "langid-hosts")
    domains = hosts.groupBy("domain").agg(*again("d", "h")).select("domain", pack("d"))
    suffixes = hosts.groupBy("suffix").agg(*again("s", "h")).select("suffix", pack("s"))
    total = hosts.agg(*again("g", "h")).select(pack("g"))
    table = hosts.select("host", "domain", "suffix", pack("h")).join(common.bounded(domains), "domain").join(common.bounded(suffixes), "suffix").join(F.broadcast(total)).select("host", "h", "d", "s", "g")
    declarations = rows.groupBy("declared").agg(F.count("*").alias("n"), *sums("c")).select("declared", "n", pack("c"))
    declarations, _ = common.written(declarations, "langid-declared")
    overall = declarations.agg(F.sum("n").alias("pages"), F.array(*(F.coalesce(F.sum(F.col("c")[i]), F.lit(0.0)) for i in range(n))).alias("all"))
    share = lambda i: (F.col("c")[i] + SPREAD * F.col("n") / F.col("pages")) / (F.col("all")[i] + SPREAD)
    spoken = declarations.join(F.broadcast(overall)).select("declared", F.array(*(share(i) for i in range(n))).alias("p_declared"))

    def level(counts: str, above: F.Column | None) -> F.Column:
        own = F.zip_with(counts, "r", lambda c, r: F.greatest(c - r, F.lit(0.0)))  # all pages but this one
        size = F.aggregate(own, F.lit(0.0), lambda a, b: a + b)
        if above is None:
            return F.transform(own, lambda c: (c + 1.0) / (size + n))
        return F.zip_with(own, above, lambda c, p: (c + STRENGTH * p) / (size + STRENGTH))

    joined = rows.join(common.bounded(table), "host").join(common.bounded(spoken), "declared")
    for name, counts, above in (("p_g", "g", None), ("p_s", "s", "p_g"), ("p_d", "d", "p_s"), ("p_h", "h", "p_d")):
        joined = joined.withColumn(name, level(counts, None if above is None else F.col(above)))
    scores = F.zip_with(F.zip_with("t", F.transform("p_declared", lambda p: F.log(p)), lambda a, b: a + b), F.transform("p_h", lambda p: F.log(p)), lambda a, b: a + b)
    fused = joined.withColumn("p", _softmax(scores))
    best = F.array_position("p", F.array_max("p")).cast("int")
    return fused.select("page_id", F.element_at(F.array(*map(F.lit, names)), best).alias("lang"), F.array_max("p").alias("p_lang"), "declared", "host")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's language by its text, declaration and address."""
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)
