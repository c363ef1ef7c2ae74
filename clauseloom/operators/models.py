"""Trainable stand-ins for the two clause classifiers and the text encoder."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, Normalizer, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: share of the class ratio used as weight of the positive class.
CONSERVATIVE_FACTOR = 0.4


def class_balance(samples: DataFrame) -> DataFrame:
    """n, positives, negatives and the weight of the positive class."""
    counts = samples.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives"),
                         F.count_if(F.col("label") == 0).alias("negatives"))
    return counts.withColumn("positive_weight", F.when(
        F.col("positives") > 0, F.col("negatives") / F.col("positives") * CONSERVATIVE_FACTOR).otherwise(1.0))


def with_class_weight(samples: DataFrame) -> DataFrame:
    """The one-row balance joined back as a weight column."""
    weight = class_balance(samples).select("positive_weight")
    return samples.crossJoin(F.broadcast(weight)).withColumn(
        "weight", F.when(F.col("label") == 1, F.col("positive_weight")).otherwise(1.0)).drop("positive_weight")


def _features(dimension: int) -> list:
    return [
        RegexTokenizer(inputCol="text", outputCol="_tokens", pattern=r"(?U)\s+", toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimension),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="features"),
    ]


def train_binary(samples: DataFrame, dimension: int = 1 << 14, rounds: int = 20):
    """``samples``: text, label 0/1.  Weighted logistic regression on hashed TF-IDF."""
    stages = _features(dimension) + [
        LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, regParam=0.001)]
    return Pipeline(stages=stages).fit(with_class_weight(samples))


def binary_probability(model, rows: DataFrame) -> DataFrame:
    """Adds ``probability`` of the positive class."""
    scored = model.transform(rows.withColumn("weight", F.lit(1.0)))
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias("probability"))


def train_multiclass(samples: DataFrame, dimension: int = 1 << 14, rounds: int = 20):
    """``samples``: text, label string.  Labels are indexed in alphabetical order."""
    indexer = StringIndexer(inputCol="label", outputCol="_label", stringOrderType="alphabetAsc").fit(samples)
    stages = [indexer] + _features(dimension) + [
        LogisticRegression(featuresCol="features", labelCol="_label", family="multinomial", maxIter=rounds, regParam=0.001),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)]
    return Pipeline(stages=stages).fit(samples)


def multiclass_prediction(model, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows)
    return scored.select(*rows.columns, "predicted", F.array_max(vector_to_array("probability")).alias("confidence"))


def encoder(texts: DataFrame, dimension: int = 384):
    """Default text encoder: hashed TF-IDF on the unit sphere, any dimension."""
    return Pipeline(stages=_features(dimension)).fit(texts)


def encode(model, texts: DataFrame) -> DataFrame:
    return model.transform(texts).select(
        *texts.columns, vector_to_array("features", "float32").alias("vec"))
