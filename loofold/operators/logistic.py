"""L2 logistic regression, converged, with the sums that leave-one-out needs.

The objective is the sum of log-losses plus ||w||^2 / (2 C); the intercept carries no
penalty. One aggregate over the rows yields loss, gradient and Hessian, which is a Newton
step and also what evaluation builds on; under ten such passes converge. With many
features the Hessian is dear, and MLlib's fit, whose passes are cheaper but more, comes
first. The folds of a cross-validation share each pass, so their number does not change
the number of jobs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loofold.functions.scalars import linear_predictor, quoted, sigmoid
from loofold.operators.linear import NARROW
from loofold.operators.prep import assemble
from loofold.operators.sums import summed

MAX_FEATURES = 2_000
WIDE = 128
"""With more features than this MLlib fits first and Newton only finishes."""
CHUNK_CELLS = 4_000_000
"""Doubles that a task's temporary matrices may hold."""
STEP_TOLERANCE = 1e-6
"""A Newton step this small leaves an error of about its square, so it is the last one."""
MAX_PASSES = 60


class TooManyFeatures(ValueError):
    """More features than a dense Hessian may have."""


class NotConverged(ValueError):
    """A fit that did not come to rest; its weights are not given."""
MISSING = "missing values among features or labels; impute them first"


@dataclass
class Sums:
    """What one pass yields for each of K weight vectors."""

    n: np.ndarray
    positives: np.ndarray
    loss: np.ndarray
    gradient: np.ndarray
    hessian: np.ndarray


@dataclass
class LogisticFit:
    features: list[str]
    label: str
    c: float
    weights: np.ndarray
    """Coefficients, then the intercept."""
    n: int
    positives: int
    hessian: np.ndarray
    loss: float
    passes: int

    @property
    def coefficients(self) -> np.ndarray:
        return self.weights[:-1]

    @property
    def intercept(self) -> float:
        return float(self.weights[-1])

    def eta(self) -> Column:
        return linear_predictor(self.features, self.coefficients, self.intercept)

    def probability(self) -> Column:
        return sigmoid(self.eta())


class SingleClass(ValueError):
    """The labels hold one class only, so the penalised fit has no finite optimum."""

    def __init__(self, label: int):
        super().__init__(f"all labels are {label}")
        self.label = label


def penalty(d: int, c: float) -> np.ndarray:
    return np.append(np.full(d, 1.0 / c), 0.0)


def model_rows(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Kept columns, then features as x0.., then y: the narrow frame all passes read."""
    return df.select(
        *[F.col(quoted(c)) for c in keep],
        *[F.col(quoted(c)).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
        F.col(quoted(label)).cast("double").alias("y"),
    )


def narrow_sums(rows: DataFrame, w: np.ndarray) -> Sums:
    """One weight vector, few features: plain SQL sums in generated code."""
    d = len(w) - 1
    number = [f"double('{float(x)!r}')" for x in w]
    eta = " + ".join([number[-1], *[f"{number[i]} * x{i}" for i in range(d)]])
    p = "IF(eta >= 0D, 1D / (1D + exp(-eta)), exp(eta) / (1D + exp(eta)))"
    loss = "greatest(eta, 0D) - y * eta + log1p(exp(-abs(eta)))"
    a = [*[f"x{i}" for i in range(d)], "1D"]
    cells = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    row = (
        rows.selectExpr("*", f"{eta} AS eta")
        .selectExpr("*", f"{p} AS p")
        .selectExpr("*", "p - y AS r", "p * (1D - p) AS v")
        .selectExpr(
            "count(1) AS n",
            "count(y * eta) AS complete",
            "sum(y) AS positives",
            f"sum({loss}) AS loss",
            *[f"sum(r * {a[i]}) AS g{i}" for i in range(d + 1)],
            *[f"sum(v * {a[i]} * {a[j]}) AS h{i}_{j}" for i, j in cells],
        )
        .first()
    )
    if row["complete"] != row["n"]:
        raise ValueError(MISSING)
    hessian = np.zeros((d + 1, d + 1))
    for i, j in cells:
        hessian[i, j] = hessian[j, i] = row[f"h{i}_{j}"] or 0.0
    return Sums(
        np.array([row["n"]]),
        np.array([row["positives"] or 0.0]),
        np.array([row["loss"] or 0.0]),
        np.array([[row[f"g{i}"] or 0.0 for i in range(d + 1)]]),
        hessian[None],
    )


def summed_blocks(rows: DataFrame, add_chunk, k: int, width: int, cost: int) -> np.ndarray:
    """A k x width table of sums over all rows.

    ``add_chunk(totals, columns)`` adds some rows, given as one array per column, to a
    task's own table; ``cost`` is how many doubles it needs per row. The caller bounds k
    (see ``block_size``).
    """
    chunk = max(1, CHUNK_CELLS // cost)

    def add(totals: np.ndarray, batch: pa.RecordBatch) -> None:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        for at in range(0, batch.num_rows, chunk):
            add_chunk(totals.reshape(k, width), [c[at : at + chunk] for c in columns])

    return summed(rows, add, k * width).reshape(k, width)


def fold_sums(rows: DataFrame, weights: np.ndarray, fold: str | None = None) -> Sums:
    """K weight vectors in one pass; with ``fold``, vector k skips the rows of fold k."""
    k, d1 = weights.shape
    d = d1 - 1
    upper = np.triu_indices(d1)
    width = 3 + d1 + len(upper[0])

    def add_chunk(totals: np.ndarray, data: list[np.ndarray]) -> None:
        y = data[d]
        a = np.column_stack([*data[:d], np.ones(len(y))])
        eta = a @ weights.T
        p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
        used = (data[d + 1][:, None] != np.arange(k)).astype(float) if fold else np.ones_like(eta)
        loss = np.logaddexp(0.0, eta) - y[:, None] * eta
        totals[:, 0] += used.sum(axis=0)
        totals[:, 1] += y @ used
        totals[:, 2] += (loss * used).sum(axis=0)
        totals[:, 3 : 3 + d1] += ((p - y[:, None]) * used).T @ a
        v = p * (1.0 - p) * used
        if k > 4:
            totals[:, 3 + d1 :] += v.T @ (a[:, upper[0]] * a[:, upper[1]])
        else:  # few fits: one product each, without the matrix of pairs
            for i in range(k):
                totals[i, 3 + d1 :] += ((a * v[:, i : i + 1]).T @ a)[upper]

    columns = [f"x{i}" for i in range(d)] + ["y"] + ([fold] if fold else [])
    table = summed_blocks(rows.select(*columns), add_chunk, k, width, k + (width if k > 4 else 2 * d1))
    hessian = np.zeros((k, d1, d1))
    hessian[:, upper[0], upper[1]] = table[:, 3 + d1 :]
    hessian[:, upper[1], upper[0]] = table[:, 3 + d1 :]
    return Sums(table[:, 0], table[:, 1], table[:, 2], table[:, 3 : 3 + d1], hessian)


def block_size(width: int, budget: int = 2_000_000) -> int:
    """How many weight vectors share a pass: their sums stay within ``budget`` doubles."""
    return max(1, min(4096, budget // width))


def sums_width(d: int) -> int:
    return 3 + (d + 1) + (d + 1) * (d + 2) // 2


def newton(sums_at, weights: np.ndarray, ridge: np.ndarray, anchor: np.ndarray | float = 0.0):
    """Drive K fits to their optimum; ``sums_at(weights, index)`` is one pass.

    ``ridge`` holds the penalty of each weight. ``anchor`` is added to every Hessian, to
    fix a direction the objective does not depend on. A step that raises the objective is
    halved; a fit that still moves after MAX_PASSES raises. Returns the weights, the Hessians of the last pass (penalty and anchor
    included), the losses and the number of passes.
    """
    k, d1 = weights.shape
    best = weights.copy()
    best_value = np.full(k, np.inf)
    step = np.zeros_like(weights)
    hessian = np.zeros((k, d1, d1))
    loss = np.zeros(k)
    active = np.arange(k)
    passes = 0
    while len(active) and passes < MAX_PASSES:
        trial = best[active] + step[active]
        s = sums_at(trial, active)
        passes += 1
        if not np.isfinite(s.gradient).all():
            raise ValueError(MISSING)
        value = s.loss + 0.5 * (trial * trial) @ ridge
        still = []
        for i, f in enumerate(active):
            slack = 1e-12 * max(1.0, abs(best_value[f])) if np.isfinite(best_value[f]) else 0.0
            if value[i] > best_value[f] + slack:
                step[f] *= 0.5
                if np.abs(step[f]).max() > STEP_TOLERANCE:
                    still.append(f)
                continue
            best[f], best_value[f], loss[f] = trial[i], value[i], s.loss[i]
            hessian[f] = s.hessian[i] + np.diag(ridge) + anchor
            step[f] = -np.linalg.solve(hessian[f], s.gradient[i] + ridge * trial[i])
            if np.abs(step[f]).max() <= STEP_TOLERANCE:
                best[f] = best[f] + step[f]
            else:
                still.append(f)
        active = np.array(still, dtype=int)
    if len(active):
        raise NotConverged(f"{len(active)} of {k} fits still move after {passes} passes")
    return best, hessian, loss, passes


def fit_logistic(
    df: DataFrame, features: Sequence[str], label: str, c: float = 1.0, start: np.ndarray | None = None
) -> LogisticFit:
    """Fit to full convergence. Cache ``df`` first if it is costly to recompute.

    ``start`` gives known weights to begin with, as for a repeated run.
    """
    d = len(features)
    if d > MAX_FEATURES:
        raise TooManyFeatures(f"{d} features: the Hessian is dense, the limit is {MAX_FEATURES}")
    rows = model_rows(df, features, label)
    if start is None:
        start = mllib_start(df, features, label, c) if d > WIDE else np.zeros(d + 1)
    weights = np.asarray(start, float)[None]
    seen: dict[str, float] = {}

    def sums_at(w: np.ndarray, _index: np.ndarray) -> Sums:
        s = narrow_sums(rows, w[0]) if d < NARROW else fold_sums(rows, w)
        seen["n"], seen["positives"] = int(s.n[0]), int(s.positives[0])
        if seen["n"] == 0:
            raise ValueError("no rows to fit")
        if seen["positives"] in (0, seen["n"]):
            raise SingleClass(int(seen["positives"] > 0))
        return s

    best, hessian, loss, passes = newton(sums_at, weights, penalty(d, c))
    return LogisticFit(
        list(features), label, c, best[0], seen["n"], seen["positives"], hessian[0], float(loss[0]), passes
    )


def mllib_model(df: DataFrame, features: Sequence[str], label: str, c: float, n: int, **options):
    """MLlib's estimator under the same objective: its penalty multiplies the mean loss."""
    from pyspark.ml.classification import LogisticRegression

    settings = {"maxIter": 50, "tol": 1e-6, **options}
    estimator = LogisticRegression(
        featuresCol="__f", labelCol="__y", regParam=1.0 / (c * n), elasticNetParam=0.0,
        standardization=False, **settings,
    )
    rows = assemble(df, features, "__f").withColumn("__y", F.col(quoted(label)).cast("double"))
    return estimator.fit(rows.select("__f", "__y"))


def mllib_start(df: DataFrame, features: Sequence[str], label: str, c: float) -> np.ndarray:
    row = df.agg(F.count(F.lit(1)), F.min(quoted(label)), F.max(quoted(label))).first()
    if row[0] == 0:
        raise ValueError("no rows to fit")
    if row[1] == row[2]:
        raise SingleClass(int(row[1]))
    model = mllib_model(df, features, label, c, row[0], family="binomial")
    return np.append(model.coefficients.toArray(), model.intercept)


def score(df: DataFrame, fit: LogisticFit) -> DataFrame:
    """Adds eta, p and prediction of the fitted model."""
    return df.withColumn("eta", fit.eta()).withColumns(
        {"p": sigmoid(F.col("eta")), "prediction": (F.col("eta") >= 0).cast("int")}
    )
