"""Classifiers beside nearest neighbours, on the features of a split table.

Trees, forests, logistic regression and linear machines are the library's and
train distributed. The kernel machine is approximate: random Fourier features
of the RBF kernel, then linear machines one against the rest.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskforge.functions.arrays import selected


def fourier(split: DataFrame, n: int = 64, gamma: float | None = None, seed: int = 0) -> DataFrame:
    """Features replaced by n cosines whose products approach exp(-gamma d^2); gamma defaults to 1 / features."""
    d = split.select(F.max(F.size("features"))).first()[0]
    rng = np.random.default_rng(seed)
    w = rng.normal(0, math.sqrt(2 * (gamma or 1 / d)), (n, d))
    shift = rng.uniform(0, 2 * math.pi, n)
    dot = lambda row: F.aggregate(F.zip_with("features", F.array(*map(F.lit, row)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return split.withColumn("features", F.array(*[math.sqrt(2 / n) * F.cos(dot([float(v) for v in row]) + float(b)) for row, b in zip(w, shift, strict=True)]))


def estimator(kind: str, d: int, classes: int, seed: int = 0):
    if kind == "rf":
        return RandomForestClassifier(numTrees=100, seed=seed)
    if kind == "dt":
        return DecisionTreeClassifier(maxDepth=15, seed=seed)
    if kind == "lr":
        return LogisticRegression(regParam=0.01, maxIter=50)
    if kind in ("linear_svc", "rbf_svm"):
        return OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.01))
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[d, 16, classes], maxIter=50, seed=seed)
    raise ValueError(f"unknown classifier {kind!r}")


def predictions(split: DataFrame, kind: str, mask: list[int] | None = None, seed: int = 0) -> DataFrame:
    """row_id, y, p of the validation rows; ``mask`` selects features."""
    rows = split if mask is None else split.withColumn("features", selected(F.col("features"), F.array(*map(F.lit, mask))))
    rows = fourier(rows, seed=seed) if kind == "rbf_svm" else rows
    d, classes = rows.agg(F.max(F.size("features")), F.max("label") + 1).first()
    vectors = rows.select("row_id", array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"), "is_valid")
    model = estimator(kind, d, int(classes), seed).fit(vectors.where(~F.col("is_valid")))
    return model.transform(vectors.where("is_valid")).select("row_id", F.col("label").cast("long").alias("y"), F.col("prediction").cast("long").alias("p"))
