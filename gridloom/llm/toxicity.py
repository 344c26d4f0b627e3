"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(theta_k - w . x): one weight vector for all thresholds theta_0 < theta_1 < ..., over sparse
features: words and word beginnings, x = log(1 + 100 count / (words + 10)). The expected severity is the sum of
P(grade > k).

Labels say toxic or not; the severity grade of a toxic document is the third of the density (occurrences for each
word of text) of words that lean towards toxic documents. A table with grades of its own can be given instead.
The model is fitted on a sample of at most ``MAX_ROWS`` labelled documents, taken in the order of a hash of their
ids; features are selected among the sample's by their G-squared statistic. Scoring reads every document whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled documents that the model is fitted on, at most.
MAX_ROWS = 8_000
#: Features that may have a weight, at most, and the least G-squared statistic and documents of one.
MAX_FEATURES, MIN_G2, MIN_DOCS = 1_000, 15.0, 4
#: Lengths of the word beginnings that are features; a beginning is written with a star at its end.
PREFIXES = (4, 5, 6, 7, 8)
GRADES = 4
#: Texts whose features a worker holds at once.
CHUNK = 32
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; none for null."""
    return _WORD.findall((text or "").lower())


def features(found: list[str]) -> Counter:
    """Counts of words and of the beginnings of longer ones."""
    counts = Counter(found)
    for word, n in list(counts.items()):
        for k in PREFIXES:
            if len(word) > k:
                counts[word[:k] + "*"] += n
    return counts


def value(count: float, total: int) -> float:
    """A feature's value: its logarithmic rate for each hundred words, less in short texts."""
    return math.log1p(100 * count / (total + 10))


@dataclass
class Model:
    """Weights by word and the ascending thresholds."""

    weights: dict[str, float]
    thresholds: list[float]

    def __post_init__(self) -> None:
        self.heads = {w.rstrip("*")[:4] for w in self.weights}

    def exceed(self, score: float) -> list[float]:
        """P(grade > k) for each threshold."""
        return [0.0 if t == math.inf else 1 / (1 + math.exp(max(-60.0, min(60.0, t - score)))) for t in self.thresholds]

    def score(self, text: str | None) -> float:
        found, heads = words(text), self.heads
        counts = features([w for w in found if w[:4] in heads])
        return sum(self.weights[w] * value(n, len(found)) for w, n in sorted(counts.items()) if w in self.weights)


@dataclass
class Sparse:
    """A matrix by its entries."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    @staticmethod
    def of(x: np.ndarray) -> Sparse:
        rows, columns = np.nonzero(x)
        return Sparse(rows, columns, x[rows, columns], x.shape)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], self.shape[0])

    def transposed_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * g[self.rows], self.shape[1])


def fit(x: Sparse, grade: np.ndarray, grades: int, steps: int = 600, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the mean log likelihood with squared decay."""
    n, d = x.shape
    k, every = grades - 1, np.arange(n)
    at = np.zeros(d + k)
    at[d:] = [1.0, *[0.5] * (k - 1)]
    m, v = np.zeros_like(at), np.zeros_like(at)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, steps + 1):
        theta = at[d] + np.concatenate([[0], np.cumsum(np.log1p(np.exp(at[d + 1 :])))])
        cdf = np.concatenate([np.zeros((n, 1)), sigmoid(theta[None] - x.dot(at[:d])[:, None]), np.ones((n, 1))], axis=1)
        slope = cdf * (1 - cdf)
        p = np.maximum(cdf[every, grade + 1] - cdf[every, grade], 1e-12)
        above, below = slope[every, grade + 1] / p, slope[every, grade] / p
        g_theta = (np.bincount(grade, below, grades)[1:] - np.bincount(grade, above, grades)[:-1]) / n
        tail = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate([x.transposed_dot(above - below) / n + decay * at[:d], tail[:1], tail[1:] * sigmoid(at[d + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        at -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return at[:d], at[d] + np.concatenate([[0], np.cumsum(np.log1p(np.exp(at[d + 1 :])))])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, CHUNK):
        found = [words(t) for t in batch.column(1).to_pylist()]
        counts = [features(x) for x in found]
        columns = [pa.array([*map(len, found)], pa.int32()), pa.array([[*c] for c in counts], pa.list_(pa.string())), pa.array([[*c.values()] for c in counts], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["toxic", "total", "words", "counts"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", grade: str | None = None, max_rows: int = MAX_ROWS) -> Model:
    """Fit a model on labelled documents. ``label`` above zero is toxic; ``grade``, if given, holds whole grades from
    zero. Rows with a null id or label are not used. Without documents of both kinds no word gets a weight, and
    nothing is toxic."""
    column = F.col(grade or label).cast("int")
    slim = labels.select(F.col(doc_id).alias("_id"), column.alias("toxic")).where("_id IS NOT NULL AND toxic IS NOT NULL")
    sample = slim.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    chosen = texts.join(F.broadcast(sample), "_id").select("toxic", "_text")  # at most max_rows rows are sent
    counted, path = common.written(chosen.mapInArrow(_counted, "toxic int, total int, words array<string>, counts array<int>"), "toxicity")
    n, n_toxic = counted.agg(F.count("*"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0))).first()
    n_toxic = n_toxic or 0
    if not n or n_toxic in (0, n):
        return Model({}, [math.inf] * (GRADES - 1))
    seen = counted.select(F.explode("words").alias("word"), (F.col("toxic") > 0).cast("long").alias("t")).groupBy("word").agg(F.sum("t").alias("a"), F.count("*").alias("df"))
    cells = []
    for inside, total, share in (("a", n_toxic, "df"), ("df - a", n - n_toxic, "df")):
        expected = f"({share} * {total} / {n})"
        absent, missing = f"({total} - ({inside}))", f"({total} - {expected})"
        cells += [f"coalesce(({inside}) * ln(nullif({inside}, 0) / {expected}), 0)", f"coalesce({absent} * ln(nullif({absent}, 0) / nullif({missing}, 0)), 0)"]
    ranked = seen.where(f"df >= {MIN_DOCS}").withColumn("g2", F.expr("2 * (" + " + ".join(cells) + ")"))
    picked = ranked.where(f"g2 >= {MIN_G2}").orderBy(F.desc(F.round("g2", 6)), "word").limit(MAX_FEATURES).collect()
    index = {r.word: i for i, r in enumerate(picked)}
    hit = F.filter(F.arrays_zip("words", "counts"), lambda z: z["words"].isin(list(index) or [""]))
    found = counted.select("toxic", "total", F.xxhash64("words", "counts").alias("h"), hit.alias("hit"))
    rows = found.select("toxic", "total", "h", F.col("hit.words").alias("words"), F.col("hit.counts").alias("counts")).toPandas()
    common.remove(docs.sparkSession, path)
    rows = rows.sort_values(["toxic", "total", "h"], ignore_index=True)  # the order in which Spark returns rows must not matter
    sizes = rows["words"].map(len).to_numpy()
    whose = np.repeat(np.arange(len(rows)), sizes)
    columns = np.array([index[w] for words in rows["words"] for w in words], np.int64)
    counts = np.array([c for own in rows["counts"] for c in own], np.float64)
    total, y = rows["total"].to_numpy(np.float64), rows["toxic"].to_numpy(np.int64)
    x = Sparse(whose, columns, np.log1p(100 * counts / (total[whose] + 10)), (len(rows), len(index)))
    if grade is None:
        leaning = np.array([r.a * n > r.df * n_toxic for r in picked], np.float64)
        density = np.bincount(whose, counts * leaning[columns], len(rows)) / np.maximum(total, 1)
        cuts = np.quantile(density[y > 0], np.arange(1, GRADES - 1) / (GRADES - 1))
        grades, n_grades = np.where(y > 0, 1 + np.searchsorted(cuts, density, side="left"), 0), GRADES
    else:
        grades, n_grades = np.maximum(y, 0), int(y.max()) + 1
    weights, thresholds = fit(x, grades, n_grades)
    return Model({w: float(weights[i]) for w, i in index.items()}, [float(t) for t in thresholds])


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """The columns ``keep`` of docs (all by default) and p_toxic, severity (expected grade), grade (the most likely
    one) and rejected (p_toxic at least ``least``). Null and empty texts have no words and score as such. A kept
    column named like one of these is an error."""
    keep = docs.columns if keep is None else keep
    new = {"p_toxic": T.DoubleType(), "severity": T.DoubleType(), "grade": T.IntegerType(), "rejected": T.BooleanType()}
    if clash := set(new) & set(keep):
        raise ValueError(f"the frame already has {sorted(clash)}")
    columns = list(dict.fromkeys([*keep, text]))
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(k, v, False) for k, v in new.items())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_FEATURES words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in common.slices(batches):
            above = [own.exceed(own.score(t)) for t in batch.column(columns.index(text)).to_pylist()]
            likely = [max(range(len(p) + 1), key=lambda k, q=[1.0, *p, 0.0]: (q[k] - q[k + 1], -k)) for p in above]
            found = [pa.array([p[0] for p in above]), pa.array([sum(p) for p in above]), pa.array(likely, pa.int32()), pa.array([p[0] >= least for p in above])]
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in keep), *found], names=[*keep, *new])

    return docs.select(*columns).mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chance of being toxic, expected severity, grade and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, keep=["doc_id"])
