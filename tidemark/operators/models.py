"""Spark ML models on prepared examples: the exact alternatives to ``training``."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame


def _with_vector(examples: DataFrame) -> DataFrame:
    return examples.withColumn("features", array_to_vector("x"))


def fit_linear(train: DataFrame, label: str = "label", l2: float = 0.0):
    """Least squares on ``x ARRAY<DOUBLE>``."""
    return LinearRegression(labelCol=label, regParam=l2, elasticNetParam=0.0).fit(_with_vector(train))


def fit_classifier(train: DataFrame, label: str = "label", l2: float = 0.0, rounds: int = 20):
    """Softmax regression on ``x ARRAY<DOUBLE>``."""
    return LogisticRegression(labelCol=label, family="multinomial", regParam=l2, maxIter=rounds).fit(
        _with_vector(train)
    )


def apply_model(model, examples: DataFrame) -> DataFrame:
    """``predict``, and for classifiers ``output`` with the class probabilities."""
    scored = model.transform(_with_vector(examples)).withColumnRenamed("prediction", "predict")
    if "probability" in scored.columns:
        scored = scored.withColumn("output", vector_to_array("probability"))
    return scored.drop("features", "rawPrediction", "probability")


def coefficients(df: DataFrame, model) -> DataFrame:
    """A linear model's parameters as (pos, value); the intercept comes last."""
    values = [*map(float, model.coefficients), float(model.intercept)]
    return df.sparkSession.createDataFrame(list(enumerate(values)), "pos int, value double")

