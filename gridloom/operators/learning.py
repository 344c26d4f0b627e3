"""Feature statistics, normalising, training and prediction."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Features that are left out, and those that are not normalised.
DROPPED = (21, 22, 23, 38, 43, 44)
RAW = (7, 8, 26, 27, 37, 39, 40, 64)


def statistics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """feature, min, max, mean and sample deviation of each column, in one pass."""
    named = [F.struct(F.lit(c).alias("feature"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")) for c in columns]
    return rows.agg(F.array(*named).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def normalise(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 by their least and greatest values; zero where these are equal or the greatest is zero."""
    ends = rows.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))
    joined = rows.join(F.broadcast(ends))  # one row
    scaled = {c: F.when((F.col(f"_max_{c}") == 0) | (F.col(f"_max_{c}") == F.col(f"_min_{c}")), 0.0).otherwise((F.col(c) - F.col(f"_min_{c}")) / (F.col(f"_max_{c}") - F.col(f"_min_{c}"))) for c in columns}
    return joined.withColumns(scaled).drop(*ends.columns)


def models() -> dict:
    """The classifiers that are compared; 1-nearest-neighbour is :func:`nearest`."""
    return {
        "tree": DecisionTreeClassifier(labelCol="label", featuresCol="features", seed=0),
        "forest": RandomForestClassifier(labelCol="label", featuresCol="features", maxDepth=10, minInstancesPerNode=3, featureSubsetStrategy="all", seed=0),
        "bayes": NaiveBayes(labelCol="label", featuresCol="features", modelType="gaussian"),
    }


def train(rows: DataFrame, columns: list[str], kind: str = "forest") -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep"), models()[kind]]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    done = model.transform(rows)
    return done.select(*keep, F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability").alias("probability"))


def split(rows: DataFrame, key: str, label: str = "label", share: float = 0.3, fold: int = 0) -> tuple[DataFrame, DataFrame]:
    """A stratified split into training and test rows, by the order of a hash of the key inside each label."""
    from pyspark.sql import Window

    order = Window.partitionBy(label).orderBy(F.md5(F.concat_ws("|", F.lit(str(fold)), key)))
    ranked = rows.withColumn("_p", F.percent_rank().over(order))
    return ranked.where(F.col("_p") >= share).drop("_p"), ranked.where(F.col("_p") < share).drop("_p")


def nearest(train_rows: DataFrame, test_rows: DataFrame, columns: list[str], key: str, bound: int = 10_000) -> DataFrame:
    """1-nearest-neighbour by Euclidean distance: the training label of each test row. The training rows are a model
    of bounded size (an error beyond ``bound``) and are broadcast; ties go to the least key."""
    if train_rows.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} training rows")
    known = train_rows.select(F.col(key).alias("_k"), F.col("label").alias("prediction"), *(F.col(c).alias(f"_{c}") for c in columns))
    distance = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in columns), F.lit(0.0))
    scored = test_rows.select(key, "label", *columns).join(F.broadcast(known)).withColumn("_d", F.round(distance, 9))
    return scored.groupBy(key, "label").agg(F.min(F.struct("_d", "_k", "prediction"))["prediction"].alias("prediction"))


def weighted_scores(predicted: DataFrame) -> DataFrame:
    """Precision, recall and F1 by label, weighted by the label's rows."""
    counts = predicted.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    real = counts.groupBy("label").agg(F.sum("n").alias("real"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    said = counts.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("said"))
    each = real.join(said, "label", "left").fillna(0, ["said"])
    p, r = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0), F.col("hit") / F.col("real")
    each = each.withColumns({"p": p, "r": r}).withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("real")) / F.sum("real"), 6)
    return each.agg(mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"))
