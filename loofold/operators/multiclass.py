"""k-fold evaluation for any number of classes by one MLlib fit per fold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loofold.functions.scalars import quoted
from loofold.operators.logistic import mllib_model
from loofold.operators.loo import reused
from loofold.operators.prep import fit_prep
from loofold.operators.softmax import class_counts, score_by_fold
from loofold.operators.split import fold_of
from loofold.session import written_table

NEVER = -1e30
"""Intercept of a class that the training rows do not show."""


def class_code(label: str, classes: list) -> Column:
    return (F.array_position(F.array(*[F.lit(v) for v in classes]), F.col(quoted(label))) - 1).cast("double")


def fold_weights(train: DataFrame, features: Sequence[str], n_classes: int, c: float) -> np.ndarray:
    """Weights per class (n_classes x (d+1)) of an MLlib fit on rows with class codes ``y``.

    Two classes share one weight vector, the difference of theirs; with more, every class
    has its own.
    """
    weights = np.zeros((n_classes, len(features) + 1))
    weights[:, -1] = NEVER
    seen = train.agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    if seen["n"] == 0:
        raise ValueError("a fold has no training rows")
    if seen["lo"] == seen["hi"]:
        weights[int(seen["lo"]), -1] = 0.0
        return weights
    family = "binomial" if n_classes == 2 else "multinomial"
    model = mllib_model(train, features, "y", c, seen["n"], family=family)
    if n_classes == 2:
        weights[0] = 0.0
        weights[1] = np.append(model.coefficients.toArray(), model.intercept)
    else:
        found = np.column_stack([model.coefficientMatrix.toArray(), model.interceptVector.toArray()])
        weights[: len(found)] = found
    return weights


def kfold_multinomial(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    k: int = 5,
    c: float = 1.0,
    fold: Column | None = None,
) -> DataFrame:
    """Out-of-fold class of every row: key, fold, label, prediction, p.

    k fits, then one scan that scores every row under the weights of its fold.
    """
    by = (fold if fold is not None else fold_of(F.col(quoted(key)), k)).alias("fold")
    names = [f"x{i}" for i in range(len(features))]
    classes, _ = class_counts(df, label)
    rows = df.select(
        quoted(key), by, class_code(label, classes).alias("y"),
        *[F.col(quoted(f)).cast("double").alias(n) for f, n in zip(features, names, strict=True)],
    )
    with reused(rows):
        weights = np.array(
            [fold_weights(rows.where(F.col("fold") != f), names, len(classes), c) for f in range(k)]
        )
    return score_by_fold(rows, key, weights, classes)


def kfold_in_fold_prep(
    df: DataFrame,
    key: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    target: str,
    k: int = 5,
    c: float = 1.0,
    fold: Column | None = None,
) -> DataFrame:
    """Like ``kfold_multinomial`` for raw columns: fill values, scales and levels of each
    fold come from its training rows only. Levels unseen in training become zeros.

    The raw columns are written once by fold, so that reading a fold, or all but one,
    touches just those files. Rows without a target are neither fitted nor scored.
    """
    by = (fold if fold is not None else fold_of(F.col(quoted(key)), k)).alias("fold")
    used = df.where(F.col(quoted(target)).isNotNull()).select(
        quoted(key), by, *map(quoted, [*numeric, *categorical, target])
    )
    rows = written_table(used, "folds", ("fold",))
    classes, _ = class_counts(rows, target)
    parts = []
    for f in range(k):
        train = rows.where(F.col("fold") != f)
        prep = fit_prep(train, numeric, categorical)
        names = [f"x{i}" for i in range(len(prep.feature_names))]

        def model_rows(part: DataFrame, prep=prep, names=names) -> DataFrame:
            coded = part.withColumn("y", class_code(target, classes))
            return prep.transform(coded, [key, "fold", "y"], names)

        weights = np.zeros((k, len(classes), len(names) + 1))
        weights[f] = fold_weights(model_rows(train), names, len(classes), c)
        parts.append(score_by_fold(model_rows(rows.where(F.col("fold") == f)), key, weights, classes))
    return reduce(DataFrame.unionByName, parts)
