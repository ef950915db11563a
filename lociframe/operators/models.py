"""Cross-validated classifiers and regressors over feature columns."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.operators.metrics import accuracy, auroc


def _folded(df: DataFrame, features: list[str], id: str, folds: int, seed: int) -> DataFrame:
    made = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)
    return made.withColumn("fold", F.pmod(F.xxhash64(F.col(id), F.lit(seed)), F.lit(folds)).cast("int"))


def _held_out(made: DataFrame, model, folds: int) -> list[DataFrame]:
    return [model.fit(made.where(F.col("fold") != k)).transform(made.where(F.col("fold") == k)) for k in range(folds)]


def forest_auroc(df: DataFrame, features: list[str], label: str, id: str, folds: int = 8, trees: int = 100, depth: int = 8, seed: int = 44) -> DataFrame:
    """(fold, n, positives, auroc) of a random forest, by deterministic folds."""
    model = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    whole = reduce(DataFrame.unionByName, _held_out(_folded(df, features, id, folds, seed), model, folds))
    scored = whole.select("fold", (F.col(label) > 0).alias("y"), vector_to_array("probability")[1].alias("s"))
    return auroc(scored, ["fold"], "y", "s")


def ridge_auroc(df: DataFrame, features: list[str], label: str, id: str, folds: int = 8, alpha: float = 1.0, seed: int = 44) -> DataFrame:
    """The same of a logistic regression with a quadratic penalty."""
    model = LogisticRegression(labelCol=label, regParam=alpha, elasticNetParam=0.0)
    whole = reduce(DataFrame.unionByName, _held_out(_folded(df, features, id, folds, seed), model, folds))
    scored = whole.select("fold", (F.col(label) > 0).alias("y"), vector_to_array("probability")[1].alias("s"))
    return auroc(scored, ["fold"], "y", "s")


def score_auroc(df: DataFrame, label: str, score: str, id: str, folds: int = 8, seed: int = 44) -> DataFrame:
    """The same of a single score."""
    scored = df.select(F.pmod(F.xxhash64(F.col(id), F.lit(seed)), F.lit(folds)).cast("int").alias("fold"), (F.col(label) > 0).alias("y"), F.col(score).alias("s"))
    return auroc(scored, ["fold"], "y", "s")


def forest_accuracy(df: DataFrame, features: list[str], value: str, id: str, folds: int = 8, trees: int = 50, depth: int = 8, seed: int = 44) -> DataFrame:
    """(fold, n, pearsonr, r2, explained) of a random forest regression."""
    model = RandomForestRegressor(labelCol=value, numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="log2")
    whole = reduce(DataFrame.unionByName, _held_out(_folded(df, features, id, folds, seed), model, folds))
    return accuracy(whole, ["fold"], value, "prediction")


def factorised(df: DataFrame, row: str, column: str, value: str, rank: int, rounds: int = 10, penalty: float = 0.01, seed: int = 44) -> tuple[DataFrame, DataFrame]:
    """Two tables of non-negative factors, (row, factors) and (column, factors), whose products come near the values, by
    alternating least squares over blocks of both. Cells that are missing count for nothing; row and column are whole
    numbers."""
    model = ALS(rank=rank, maxIter=rounds, regParam=penalty, nonnegative=True, userCol=row, itemCol=column, ratingCol=value, seed=seed).fit(df)
    return model.userFactors.select(F.col("id").alias(row), F.col("features").alias("factors")), model.itemFactors.select(F.col("id").alias(column), F.col("features").alias("factors"))
