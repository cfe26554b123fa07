"""Learning the mode of transport from features."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators.features import haar

# Settings of the perceptron.
HIDDEN = (12, 6)
SEED, BLOCK, TOLERANCE, ITERATIONS = 1234, 128, 1e-6, 400


def haar_vectors(df: DataFrame, key: str, values: str, label: str, width: int) -> DataFrame:
    """(key, features VECTOR, label DOUBLE): Haar transforms of arrays of ``width`` values."""
    doubles = F.transform(values, lambda x: x.cast("double"))
    return df.where(F.size(values) == width).select(key, array_to_vector(haar(doubles, width)).alias("features"), F.col(label).cast("double").alias("label"))


def split(df: DataFrame, key: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key, so that a row falls on the same side at any partitioning."""
    part = F.pmod(F.xxhash64(key), F.lit(1000)) < int(share * 1000)
    return df.where(part), df.where(~part)


def perceptron(width: int, classes: int, iterations: int = ITERATIONS) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[width, *HIDDEN, classes + 1], tol=TOLERANCE, blockSize=BLOCK, seed=SEED, maxIter=iterations)


def cross_validated(train: DataFrame, model: object, folds: int = 10) -> object:
    """The model fit on all of ``train`` after ``folds``-fold cross validation by accuracy."""
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    return CrossValidator(estimator=model, estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge, numFolds=folds, seed=SEED).fit(train)


def accuracy(predictions: DataFrame) -> float:
    return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(predictions)


def logistic(iterations: int = 10, penalty: float = 0.01) -> LogisticRegression:
    return LogisticRegression(maxIter=iterations, regParam=penalty)


def save(model: object, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> object:
    from pyspark.ml.util import DefaultParamsReader

    return DefaultParamsReader.loadParamsInstance(path, SparkSession.active().sparkContext)


def perceptron_predictions(df: DataFrame, key: str, values: str, label: str, width: int = 64, iterations: int = ITERATIONS) -> DataFrame:
    """(key, label, prediction) of the held-out rows."""
    train, test = split(haar_vectors(df, key, values, label, width), key)
    classes = int(train.agg(F.max("label")).first()[0] or 0) + 1
    kept = train.persist()
    try:
        model = perceptron(width, classes, iterations).fit(kept)
    finally:
        kept.unpersist()
    return model.transform(test).select(key, F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))
