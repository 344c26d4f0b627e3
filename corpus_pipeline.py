"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; every stage but the last returns the
columns of documents. SQL can express neither the trained model, MinHash, XXH64 nor BPE, so there is no oracle; the
tests hold every stage against a version in plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, common, linededup, mixing, neardup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A source gets at most so many times the epochs of the largest one.
MAX_REPETITION = 1.25


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go; all others stay as they are. Null and empty texts have no features
    and score by the model's thresholds alone; repeated rows score alike. Each stage reads and returns ``COLUMNS``."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where(~F.col("rejected")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines one stays. A document that loses lines gets their text taken out and its length anew; one
    that has no text left stays, empty."""
    done = linededup.dedup(docs.select(*COLUMNS))
    length = F.when(F.size("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", length).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal documents (five-word Jaccard similarity 0.8 or more) the one with the smallest id
    stays, a null id only where the whole group has none; ties go to the least hash of the row. Null, empty and white
    texts are one group; very long ones are compared whole."""
    return neardup.keep_one(docs.select(*COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated up to ``MAX_REPETITION`` times; the budget takes every document at least once. Rows
    without a source are a source; rows of equal id are taken together or not at all."""
    return mixing.mix(docs.select(*COLUMNS), max_repetition=MAX_REPETITION, budget=None).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every emitted document, and whether they decode to its text; a null text is an empty one."""
    import public_tokenizers

    shared = bpe.codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.checked(docs.select("doc_id", "source", "text"), shared, keep=["doc_id", "source"])


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", source_mixing),
    ("bpe", tokenise),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
