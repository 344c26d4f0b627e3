"""Sources: XML dumps, compressed pages, TSV, N-Triples, decimal-comma CSV and table JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Namespaces that hold no articles, and the smallest article.
SKIPPED_NAMESPACES = ["Wikipedia", "Category", "File", "Portal", "Template", "MediaWiki", "User", "Help", "Book", "Draft", "WikiProject", "Special", "Talk"]
MIN_LENGTH = 200
TABLE_SCHEMA = (
    "tableId string, title string, htmlMatrix array<array<string>>, startRows int, colHeaders array<string>, rowHeaders array<string>, nrows int, ncols int, html string, "
    "tableType string, articleTitle string, articleId string, attrs map<string,string>, articlePath string, articleEntity string, articleClass string, columnClasses map<string,map<string,int>>"
)


def xml_pages(spark: SparkSession, path: str) -> DataFrame:
    """title and text of each page of an XML dump."""
    schema = "title string, ns string, revision struct<text:string>"
    return spark.read.format("xml").option("rowTag", "page").schema(schema).load(path).select("title", F.col("revision.text").alias("text"))


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages in files of their own (compressed or not): path, html, and a repeatable id."""
    found = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))
    return found.withColumn("page_id", F.xxhash64("path"))


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated text, compressed or not, without quoting."""
    return spark.read.csv(path, sep="\t", schema=schema, quote="")


def decimal_comma(column: str | Column) -> Column:
    return F.regexp_replace(column, ",", ".").cast("double")


def n_triples(lines: DataFrame, value: str = "value") -> DataFrame:
    """s, p, o of N-Triples lines; others are left out."""
    part = lambda i: F.regexp_extract(value, r"^(\S+) (\S+) (.+) \.\s*$", i)
    return lines.select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o")).where("s <> ''")


def table_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMA).json(path, multiLine=True)


def sections(pages: DataFrame) -> DataFrame:
    """pos, heading and body of each page's sections; the first is the introduction. A null text has none."""
    bodies = F.split("text", r"\n==[^=][^\n]*[^=]==\n", -1)
    heads = F.concat(F.array(F.lit("Introduction")), F.transform(F.regexp_extract_all("text", F.lit(r"\n==([^=][^\n]*[^=])==\n"), 1), lambda h: F.trim(h)))
    each = pages.where("text IS NOT NULL").select("title", F.posexplode(F.arrays_zip(heads.alias("heading"), bodies.alias("body"))).alias("pos", "s"))
    return each.select("title", "pos", F.col("s.heading").alias("heading"), F.col("s.body").alias("body"))


def article_filter(pages: DataFrame) -> DataFrame:
    """Pages with the reason for which they are skipped, or null: namespace, redirect, disambiguation or length."""
    space = F.substring_index("title", ":", 1)
    length = F.aggregate(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n==[^=][^\n]*[^=]==\n", -1), lambda b: F.length(F.trim(b))), F.lit(0), lambda a, b: a + b)
    reason = (
        F.when(F.col("title").contains(":") & space.isin(SKIPPED_NAMESPACES), "namespace")
        .when(F.col("text").isNull() | F.lower(F.ltrim(F.coalesce("text", F.lit("")))).startswith("#redirect"), "redirect")
        .when(F.col("title").endswith("(disambiguation)"), "disambiguation")
        .when(length < MIN_LENGTH, "length")
    )
    return pages.withColumn("skip_reason", reason)


def missing(titles: DataFrame, done: DataFrame) -> DataFrame:
    """Titles that have no result yet: an incremental crawl's input. The fetching itself is the caller's."""
    return titles.join(done.select("title"), "title", "left_anti")
