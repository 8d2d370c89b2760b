"""Scores and linear models of a panel.

Ridge regression needs only sums of products: one aggregation per fold gives the Gram matrix, from
which every penalty and every subset of features is solved on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.xsection import FLAT


def reference_scores(df: DataFrame, feature: str = "return_12") -> DataFrame:
    """Each row as ``momentum`` (the trailing return) and ``reversal`` (its negative)."""
    both = F.array(F.struct(F.lit("momentum").alias("model"), F.col(feature).alias("prediction")), F.struct(F.lit("reversal").alias("model"), (-F.col(feature)).alias("prediction")))
    return df.select("*", F.inline(both))


def gram_matrix(df: DataFrame, features: list[str], target: str = "target", by: list[str] = ["fold"]) -> DataFrame:  # noqa: B006
    """``by``, ``a``, ``b`` and ``value`` = sum of x_a x_b over rows, for the intercept (``1``), features and target."""
    names = ["1", *features, target]
    cols = {"1": F.lit(1.0)} | {n: F.col(n).cast("double") for n in names[1:]}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = df.groupBy(*by).agg(*[F.sum(cols[a] * cols[b]).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    return sums.select(*by, F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"s{i}").alias("value")) for i, (a, b) in enumerate(pairs)])))


def solve_ridge(gram: dict[tuple[str, str], float], features: Sequence[str], alpha: float, target: str = "target") -> dict[str, float]:
    """Coefficients and intercept (``1``) that minimise squared error plus alpha times squared coefficients; the intercept is free."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    g = lambda a, b: gram[a, b] if (a, b) in gram else gram[b, a]
    n = g("1", "1")
    mean = np.array([g("1", f) for f in features]) / n
    y = g("1", target) / n
    x = np.array([[g(a, b) for b in features] for a in features]) - n * np.outer(mean, mean)
    xy = np.array([g(f, target) for f in features]) - n * mean * y
    beta = np.linalg.solve(x + alpha * np.eye(len(features)), xy)
    return {"1": float(y - mean @ beta), **dict(zip(features, map(float, beta)))}


def linear_score(coefficients: dict[str, float]) -> Column:
    total = F.lit(coefficients["1"])
    for f, b in coefficients.items():
        if f != "1":
            total = total + F.col(f).cast("double") * F.lit(b)
    return total


def fit_ridge(train: DataFrame, features: list[str], alphas: Sequence[float], by: str = "fold") -> dict[tuple[int, float], dict[str, float]]:
    """Coefficients per (fold, alpha) from one pass; the matrix has a few hundred entries per fold."""
    grams: dict[int, dict[tuple[str, str], float]] = {}
    for r in gram_matrix(train, features, by=[by]).collect():
        grams.setdefault(r[by], {})[r["a"], r["b"]] = r["value"]
    return {(fold, a): solve_ridge(g, features, a) for fold, g in grams.items() for a in alphas}


def score_by_fold(df: DataFrame, fitted: dict[tuple[int, float], dict[str, float]], by: str = "fold") -> DataFrame:
    """Rows once per alpha with ``alpha`` and the prediction of their fold's model; an expression, no UDF."""
    alphas = sorted({a for _, a in fitted})

    def one(alpha: float) -> Column:
        out = F.lit(None).cast("double")
        for (fold, a), c in fitted.items():
            if a == alpha:
                out = F.when(F.col(by) == fold, linear_score(c)).otherwise(out)
        return out

    return df.select("*", F.inline(F.array(*[F.struct(F.lit(a).alias("alpha"), one(a).alias("prediction")) for a in alphas])))


def first_best(candidates: DataFrame, metric: str, by: list[str], candidate: str = "alpha") -> DataFrame:
    """The candidate with the highest metric per group, the smallest among equals; undefined metrics last.

    Metrics within FLAT of the highest equal it: a mean of the same values differs in its last digits by
    the order in which they were added up.
    """
    defined = F.nanvl(F.col(metric).cast("double"), F.lit(None))
    best = F.max(defined).over(Window.partitionBy(*by))
    rows = candidates.withColumn("__equal", best.isNull() | (defined >= best - FLAT))
    return rows.groupBy(*by).agg(F.min(F.when(F.col("__equal"), F.col(candidate))).alias(candidate), F.max(metric).alias(metric))


def check_families(features: Sequence[str], families: dict[str, Sequence[str]]) -> None:
    """Families must split the features: none twice, none unknown, none left out."""
    seen = [f for members in families.values() for f in members]
    if len(set(features)) != len(features):
        raise ValueError("duplicate features")
    if unknown := sorted(set(seen) - set(features)):
        raise ValueError(f"unknown features: {unknown}")
    if several := sorted({f for f in seen if seen.count(f) > 1}):
        raise ValueError(f"features in multiple families: {several}")
    if missing := sorted(set(features) - set(seen)):
        raise ValueError(f"features in no family: {missing}")


def leave_one_family_out(features: Sequence[str], families: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """``full`` and ``without_<family>`` feature sets, in feature order."""
    check_families(features, families)
    return {"full": list(features)} | {f"without_{n}": [f for f in features if f not in set(m)] for n, m in families.items()}


def delta_vs_full(df: DataFrame, metrics: list[str], by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """Each metric's value in the group's ``full`` variant and the difference from it."""
    full = df.where("variant = 'full'").select(*by, *[F.col(m).alias(f"full_{m}") for m in metrics])
    return df.join(full, by, "left").select("*", *[(F.col(m) - F.col(f"full_{m}")).alias(f"{m}_delta_vs_full") for m in metrics])


def fit_boosted_trees(train: DataFrame, validation: DataFrame, features: list[str], target: str = "target", iterations: int = 40, depth: int = 4, seed: int = 7):
    """Gradient-boosted trees with early stopping on the validation rows; a Spark ML model with ``transform``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = train.withColumn("__validation", F.lit(False)).unionByName(validation.withColumn("__validation", F.lit(True)))
    gbt = GBTRegressor(
        featuresCol="__x", labelCol=target, predictionCol="prediction", maxIter=iterations, maxDepth=depth, seed=seed, validationIndicatorCol="__validation", validationTol=1e-4
    )
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), gbt]).fit(rows)
