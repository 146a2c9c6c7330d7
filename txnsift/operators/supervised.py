"""Supervised baselines: balanced logistic regression and boosted trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnsift.operators.boosting import fit_boosted_trees
from txnsift.operators.ranks import group_sizes
from txnsift.session import materialize


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n_rows, weight): n / (classes * n_class), so that every class weighs the same."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    stats = counts.agg(F.sum("n_rows").alias("n"), F.count(F.lit(1)).alias("c")).first()
    weight = F.lit(float(stats["n"] or 0)) / (F.lit(float(stats["c"])) * F.col("n_rows"))
    return counts.withColumn("weight", weight)


def _vectors(df: DataFrame, features: Sequence[str], label: str, weights: dict) -> DataFrame:
    weight = F.lit(1.0)
    for c, w in weights.items():
        weight = F.when(F.col(label) == F.lit(c), F.lit(float(w))).otherwise(weight)
    return df.select(
        array_to_vector(F.array(*[F.col(f).cast("double") for f in features])).alias("features"),
        F.col(label).cast("double").alias("label"),
        weight.alias("weight"),
    )


def _scores(model, df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    vectors = df.withColumn("features", array_to_vector(F.array(*[F.col(f).cast("double") for f in features])))
    scored = model.transform(vectors).withColumn(name, vector_to_array("probability")[1])
    return scored.select(*df.columns, name)


def logistic_scores(
    train: DataFrame, rows: DataFrame, features: Sequence[str], label: str, name: str = "lr_score", max_iter: int = 1000
) -> DataFrame:
    """`rows` with the probability of class 1 from an L2 model with balanced class weights.

    The penalty 1 / n on unscaled coefficients is the unit-strength optimum per row.
    """
    sizes = group_sizes(train, label)
    n = sum(sizes.values())
    weights = {c: n / (len(sizes) * m) for c, m in sizes.items()}
    # stored, so that a lost executor does not compute the training rows again
    data = materialize(_vectors(train, features, label, weights), "training-rows")
    model = LogisticRegression(
        weightCol="weight", standardization=False, regParam=1.0 / n, elasticNetParam=0.0, maxIter=max_iter, tol=1e-8
    ).fit(data)
    return _scores(model, rows, features, name)


def boosted_scores(
    train: DataFrame,
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    name: str = "gbt_score",
    rounds: int = 300,
    depth: int = 5,
    rate: float = 0.08,
) -> DataFrame:
    """`rows` with the probability of class 1 from boosted trees over binned features; positives weigh neg / pos."""
    sizes = group_sizes(train, label)
    if not sizes.get(1) or not sizes.get(0):
        raise ValueError("boosted trees need rows of both classes")
    weight = round(sizes[0] / sizes[1], 2)
    return fit_boosted_trees(train, features, label, weight, rounds, depth, rate).score(rows, name)
