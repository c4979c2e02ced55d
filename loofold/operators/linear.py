"""Least squares and its exact leave-one-out errors from one set of sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loofold.functions.scalars import linear_predictor, quoted
from loofold.operators.sums import summed

NARROW = 16
"""Up to this many columns, pairwise sums are written as SQL aggregates."""
LEAST_FREE = 1e-9
"""1 - leverage below which a row carries a coefficient alone."""
CHUNK_CELLS = 2_000_000
"""Doubles that a batch's matrix may hold."""


@dataclass
class LinearFit:
    features: list[str]
    label: str
    coefficients: np.ndarray
    intercept: float
    n: int
    means: np.ndarray
    inverse: np.ndarray
    """Inverse of the centred Gram matrix (pseudo-inverse for dependent columns)."""
    root: np.ndarray
    """A factor of it: inverse = root root'."""

    def predict(self) -> Column:
        return linear_predictor(self.features, self.coefficients, self.intercept)

    def leverage(self) -> Column:
        """Diagonal of the hat matrix, per row."""
        return F.lit(1.0 / self.n) + quadratic_form(
            [F.col(quoted(c)) - F.lit(float(m)) for c, m in zip(self.features, self.means, strict=True)],
            self.inverse,
        )


def quadratic_form(terms: Sequence[Column], matrix: np.ndarray) -> Column:
    """x' M x with a literal symmetric matrix, written as nested products."""
    total = F.lit(0.0)
    for i, x in enumerate(terms):
        inner = F.lit(float(matrix[i, i])) * x
        for j in range(i + 1, len(terms)):
            inner = inner + F.lit(2.0 * float(matrix[i, j])) * terms[j]
        total = total + x * inner
    return total


def simple_ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of y on x, one row."""
    cy, cx = F.col(quoted(y)), F.col(quoted(x))
    return df.agg(
        F.regr_slope(cy, cx).alias("slope"),
        F.regr_intercept(cy, cx).alias("intercept"),
        F.regr_count(cy, cx).alias("n"),
    )


def centred_gram(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and centred Gram matrix of complete rows.

    Narrow tables use the built-in covariance aggregate, which merges partial results
    without cancellation. Wide ones add up one matrix per task, after a pass for the
    means, and add those as packed rows.
    """
    complete = df.select(*[F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    d = len(columns)
    cells = [(i, j) for i in range(d) for j in range(i, d)]
    means = [F.avg(f"c{i}").alias(f"m{i}") for i in range(d)]
    if d <= NARROW:
        row = complete.agg(
            F.count(F.lit(1)).alias("n"),
            *means,
            *[F.covar_pop(f"c{i}", f"c{j}").alias(f"s{i}_{j}") for i, j in cells],
        ).first()
    else:
        row = complete.agg(F.count(F.lit(1)).alias("n"), *means).first()
        centre = np.array([row[f"m{i}"] or 0.0 for i in range(d)])

        def add(totals: np.ndarray, batch: pa.RecordBatch) -> None:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - centre
            totals += (x.T @ x).ravel()

        gram = summed(complete, add, d * d).reshape(d, d)
        return row["n"], centre, gram
    gram = np.zeros((d, d))
    for i, j in cells:
        gram[i, j] = gram[j, i] = (row[f"s{i}_{j}"] or 0.0) * row["n"]
    return row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(d)]), gram


def fit_linear(df: DataFrame, features: Sequence[str], label: str) -> LinearFit:
    """Least squares of ``label`` on ``features`` with an intercept.

    Dependent columns get the shortest of all equally good coefficient vectors.
    """
    n, means, gram = centred_gram(df, [*features, label])
    if n == 0:
        raise ValueError("no complete rows to fit")
    d = len(features)
    scale = np.sqrt(np.where(np.diag(gram)[:d] > 0, np.diag(gram)[:d], 1.0))
    unit = gram[:d, :d] / np.outer(scale, scale)
    if d and np.linalg.eigvalsh(unit)[0] > 1e-12 * d:
        root = np.linalg.inv(np.linalg.cholesky(unit)).T / scale[:, None]
    else:
        values, vectors = np.linalg.eigh(gram[:d, :d])
        used = values > 1e-12 * max(values.max(initial=0.0), 0.0)
        root = vectors[:, used] / np.sqrt(values[used])
    inverse = root @ root.T
    coefficients = inverse @ gram[:d, d]
    return LinearFit(
        list(features), label, coefficients, float(means[d] - coefficients @ means[:d]), n, means[:d], inverse, root
    )


def loo_linear(df: DataFrame, fit: LinearFit) -> DataFrame:
    """Adds ``loo_prediction`` and ``loo_error`` to complete rows.

    The error of the model fitted without row i is e_i / (1 - h_i), exactly. A row with
    leverage 1 carries a coefficient alone; without it that coefficient is free and the
    row gets a null.
    """
    numbers = F.array(*[F.col(quoted(c)).cast("double") for c in [*fit.features, fit.label]])
    complete = df.where(F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x)))
    if len(fit.features) > NARROW:
        return _loo_wide(complete, fit)
    y = F.col(quoted(fit.label)).cast("double")
    free = F.lit(1.0) - fit.leverage()
    error = F.when(free > LEAST_FREE, (y - fit.predict()) / free)
    return complete.withColumns({"loo_error": error, "loo_prediction": y - error})


def _loo_wide(complete: DataFrame, fit: LinearFit) -> DataFrame:
    """The same by one product with the factor per Arrow batch; the plan does not grow with d^2."""
    names, n, d = complete.columns, len(complete.columns), len(fit.features)
    means, root, weights, intercept, share = fit.means, fit.root, fit.coefficients, fit.intercept, 1.0 / fit.n
    numbers = [F.col(quoted(c)).cast("double").alias(f"__{i}") for i, c in enumerate([*fit.features, fit.label])]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, CHUNK_CELLS // (d + 1))
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[n : n + d]])
                y = batch.column(n + d).to_numpy(zero_copy_only=False)
                free = 1.0 - share - np.square((x - means) @ root).sum(axis=1)
                error = (y - x @ weights - intercept) / np.where(free > LEAST_FREE, free, np.nan)
                found = [pa.array(v, mask=np.isnan(error)) for v in (error, y - error)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *found], [*names, "loo_error", "loo_prediction"])

    schema = StructType([*complete.schema.fields, StructField("loo_error", DoubleType()), StructField("loo_prediction", DoubleType())])
    return complete.select("*", *numbers).mapInArrow(measure, schema)
