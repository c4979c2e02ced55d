"""Targets with three or more classes: converged fits, leave-one-out and k-fold.

The model has one penalised weight vector and one free intercept per class. Sums, shared
passes and the leave-one-out step are those of the two-class case with a K x K block per
row instead of a number: with g = p - e_y, V = diag(p) - p p' and Q the block of H^-1
that the row touches,

    eta_loo = eta + Q (I - V Q)^-1 g.

The bound carries over as well. No class score moves against another by more than
s = sqrt(max q / (1 - rho)) * lam, where q runs over (e_k - e_l)' Q (e_k - e_l) of all
rows, rho is the largest eigenvalue of V Q and lam^2 = g' Q (I - V Q)^-1 g; probabilities
then change by factors within exp(-s) .. exp(s), and so does V.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loofold.functions.scalars import quoted
from loofold.operators.logistic import WIDE, Sums, block_size, mllib_model, newton, summed_blocks
from loofold.operators.loo import BROADCAST_ROWS, ROUND_OFF, STEP_ERROR, reused
from loofold.operators.split import fold_of
from loofold.session import scratch_folder

MAX_WEIGHTS = 2_000
"""Classes times features: the Hessian is dense."""


class TooManyWeights(ValueError):
    """Classes times features exceed what a dense Hessian can hold."""


@dataclass
class SoftmaxFit:
    features: list[str]
    classes: list
    c: float
    weights: np.ndarray
    """K x (d+1), intercepts last."""
    hessian: np.ndarray
    n: int
    counts: np.ndarray

    @property
    def size(self) -> tuple[int, int]:
        return self.weights.shape


def _ridge(k: int, d: int, c: float) -> np.ndarray:
    return np.tile(np.append(np.full(d, 1.0 / c), 0.0), k)


def _anchor(k: int, d: int) -> np.ndarray:
    """Fixes the common shift of all intercepts, which changes no probability."""
    u = np.tile(np.append(np.zeros(d), 1.0), k)
    return np.outer(u, u)


def _probabilities(eta: np.ndarray) -> np.ndarray:
    e = np.exp(eta - eta.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _width(k: int, d: int) -> int:
    return 2 + k * (d + 1) + k * (k + 1) // 2 * ((d + 1) * (d + 2) // 2)


def softmax_sums(rows: DataFrame, weights: np.ndarray, fold: str | None = None) -> Sums:
    """Sums for F weight tables (F x K x (d+1)) in one pass over x0.., y and the fold."""
    f, k, d1 = weights.shape
    d = d1 - 1
    upper, pairs = np.triu_indices(d1), np.triu_indices(k)
    cells, width = len(upper[0]), _width(k, d)
    flat = weights.reshape(f * k, d1)
    same = (pairs[0] == pairs[1]).astype(float)

    def add_chunk(totals: np.ndarray, data: list[np.ndarray]) -> None:
        y = data[d].astype(int)
        m = len(y)
        a = np.column_stack([*data[:d], np.ones(m)])
        eta = (a @ flat.T).reshape(m, f, k)
        p = _probabilities(eta)
        used = (data[d + 1][:, None] != np.arange(f)).astype(float) if fold else np.ones((m, f))
        top = eta.max(axis=2)
        loss = top + np.log(np.exp(eta - top[:, :, None]).sum(axis=2)) - eta[np.arange(m), :, y]
        totals[:, 0] += used.sum(axis=0)
        totals[:, 1] += (loss * used).sum(axis=0)
        v = (p[:, :, pairs[0]] * (same - p[:, :, pairs[1]])) * used[:, :, None]
        outer = a[:, upper[0]] * a[:, upper[1]]
        totals[:, 2 + k * d1 :] += (v.reshape(m, -1).T @ outer).reshape(f, -1)
        p[np.arange(m), :, y] -= 1.0
        r = p * used[:, :, None]
        totals[:, 2 : 2 + k * d1] += (r.reshape(m, -1).T @ a).reshape(f, -1)

    columns = [f"x{i}" for i in range(d)] + ["y"] + ([fold] if fold else [])
    cost = f * k * 4 + f * len(pairs[0]) + cells
    table = summed_blocks(rows.select(*columns), add_chunk, f, width, cost)
    blocks = table[:, 2 + k * d1 :].reshape(f, len(pairs[0]), cells)
    square = np.zeros((f, len(pairs[0]), d1, d1))
    square[:, :, upper[0], upper[1]] = blocks
    square[:, :, upper[1], upper[0]] = blocks
    hessian = np.zeros((f, k, d1, k, d1))
    for i, (a, b) in enumerate(zip(*pairs, strict=True)):
        hessian[:, a, :, b, :] = square[:, i]
        hessian[:, b, :, a, :] = square[:, i]
    return Sums(
        table[:, 0], np.zeros(f), table[:, 1], table[:, 2 : 2 + k * d1], hessian.reshape(f, k * d1, k * d1)
    )


def _model_rows(df: DataFrame, features: Sequence[str], label: str, classes: list, keep: Sequence[Column]) -> DataFrame:
    code = F.array_position(F.array(*[F.lit(v) for v in classes]), F.col(quoted(label))) - 1
    return df.select(
        *keep,
        *[F.col(quoted(c)).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
        code.cast("double").alias("y"),
    )


def fit_softmax(rows: DataFrame, d: int, classes: list, c: float, counts: np.ndarray) -> SoftmaxFit:
    """Fit on model rows to full convergence; with many weights MLlib goes first."""
    k = len(classes)
    names = [f"x{i}" for i in range(d)]
    n = int(counts.sum())
    start = np.zeros((k, d + 1))
    if k * (d + 1) > WIDE:
        model = mllib_model(rows, names, "y", c, n, family="multinomial")
        start = np.column_stack([model.coefficientMatrix.toArray(), model.interceptVector.toArray()])
        start[:, -1] -= start[:, -1].mean()

    def sums_at(w: np.ndarray, _index: np.ndarray) -> Sums:
        return softmax_sums(rows, w.reshape(1, k, d + 1))

    best, hessian, _, _ = newton(sums_at, start.reshape(1, -1), _ridge(k, d, c), _anchor(k, d))
    return SoftmaxFit(names, classes, c, best[0].reshape(k, d + 1), hessian[0], n, counts)


def _blocks(fit: SoftmaxFit, inverse: np.ndarray, data: list[np.ndarray], y: np.ndarray):
    """Per row: left-out scores, the corrected block, rho, and the widest difference."""
    k, d1 = fit.size
    m = len(y)
    a = np.column_stack([*data, np.ones(m)])
    eta = a @ fit.weights.T
    p = _probabilities(eta)
    q = np.einsum("mi,kilj,mj->mkl", a, inverse.reshape(k, d1, k, d1), a, optimize=True)
    v = p[:, :, None] * (np.eye(k) - p[:, None, :])
    g = p.copy()
    g[np.arange(m), y] -= 1.0
    moved = q @ np.linalg.inv(np.eye(k) - v @ q)
    half = np.sqrt(p)[:, :, None] * (np.eye(k) - p[:, None, :])
    rho = np.linalg.eigvalsh(half @ q @ half.transpose(0, 2, 1))[:, -1]
    return eta + np.einsum("mkl,ml->mk", moved, g), q, moved, rho, g


def _differences(q: np.ndarray) -> np.ndarray:
    """(e_k - e_l)' Q (e_k - e_l) for all k, l."""
    diagonal = np.einsum("mkk->mk", q)
    return diagonal[:, :, None] + diagonal[:, None, :] - q - q.transpose(0, 2, 1)


def max_difference(rows: DataFrame, fit: SoftmaxFit, inverse: np.ndarray) -> float:
    """The widest difference block of any row: one number per task, then their maximum."""
    d = len(fit.features)

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = 0.0
        for batch in batches:
            data = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            a = np.column_stack([*data, np.ones(batch.num_rows)])
            k, d1 = fit.size
            q = np.einsum("mi,kilj,mj->mkl", a, inverse.reshape(k, d1, k, d1), a, optimize=True)
            top = max(top, float(_differences(q).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([top])], ["q"])

    return rows.select(*[f"x{i}" for i in range(d)]).mapInArrow(widest, "q double").agg(F.max("q")).first()[0]


def left_out_classes(rows: DataFrame, key: str, fit: SoftmaxFit, inverse: np.ndarray, max_q: float) -> DataFrame:
    """Model rows with the left-out class code, its probability, and whether it is certain."""
    d = len(fit.features)
    names = [key, *fit.features, "y"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            m = batch.num_rows
            if m == 0:
                continue
            eta, _, moved, rho, g = _blocks(fit, inverse, data[:d], data[d].astype(int))
            pick = eta.argmax(axis=1)
            lead = eta[np.arange(m), pick][:, None] - eta
            lam = np.sqrt(np.maximum(np.einsum("mk,mkl,ml->m", g, moved, g), 0.0))
            free = np.maximum(1.0 - rho, 1e-12)
            width = np.sqrt(max_q / free)
            s = np.minimum(width * lam, 2.0)
            reach = np.exp(s) * (np.expm1(s) - s)
            step = -np.log1p(-np.minimum(reach, 0.99)) / width
            spread = np.sqrt(np.maximum(_differences(moved)[np.arange(m), pick], 0.0))
            shift = np.abs(np.einsum("mkl,ml->mk", moved, g)).max(axis=1)
            safe = lead > spread * step[:, None] + (STEP_ERROR * shift + ROUND_OFF)[:, None]
            safe[np.arange(m), pick] = True
            certain = safe.all(axis=1) & (reach < 0.99) & (free > 1e-6)
            p = _probabilities(eta)[np.arange(m), pick]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pick.astype(np.int32)), pa.array(p), pa.array(certain)],
                [*names, "pick", "p", "certain"],
            )

    narrow = rows.select(*map(quoted, names))
    extra = [("pick", T.IntegerType()), ("p", T.DoubleType()), ("certain", T.BooleanType())]
    schema = T.StructType([*narrow.schema.fields, *[T.StructField(n, t) for n, t in extra]])
    return narrow.mapInArrow(judge, schema)


def refit_classes(rows: DataFrame, x: np.ndarray, y: np.ndarray, fit: SoftmaxFit) -> tuple[np.ndarray, np.ndarray]:
    """Exact left-out class codes and probabilities of the given rows, in shared passes."""
    k, d1 = fit.size
    a = np.column_stack([x, np.ones(len(y))])
    codes = y.astype(int)

    def sums_at(w: np.ndarray, index: np.ndarray) -> Sums:
        w = w.reshape(-1, k, d1)
        s = softmax_sums(rows, w)
        out, label = a[index], codes[index]
        m = len(label)
        eta = np.einsum("mki,mi->mk", w, out)
        p = _probabilities(eta)
        top = eta.max(axis=1)
        loss = top + np.log(np.exp(eta - top[:, None]).sum(axis=1)) - eta[np.arange(m), label]
        v = p[:, :, None] * (np.eye(k) - p[:, None, :])
        block = np.einsum("mkl,mi,mj->mkilj", v, out, out).reshape(m, k * d1, k * d1)
        p[np.arange(m), label] -= 1.0
        gradient = np.einsum("mk,mi->mki", p, out).reshape(m, k * d1)
        return Sums(s.n - 1, s.positives, s.loss - loss, s.gradient - gradient, s.hessian - block)

    # The first step from the full fit needs no pass: its sums are known.
    p = _probabilities(a @ fit.weights.T)
    v = p[:, :, None] * (np.eye(k) - p[:, None, :])
    down = fit.hessian - np.einsum("mkl,mi,mj->mkilj", v, a, a).reshape(len(y), k * d1, k * d1)
    p[np.arange(len(y)), codes] -= 1.0
    step = np.linalg.solve(down, np.einsum("mk,mi->mki", p, a).reshape(len(y), -1, 1))[:, :, 0]
    best = newton(sums_at, fit.weights.reshape(1, -1) + step, _ridge(k, d1 - 1, fit.c), _anchor(k, d1 - 1))[0].reshape(-1, k, d1)
    p = _probabilities(np.einsum("mki,mi->mk", best, a))
    return p.argmax(axis=1), p.max(axis=1)


@dataclass
class LooClasses:
    fit: SoftmaxFit | None
    predictions: DataFrame
    """key, label, prediction, p, refitted, status."""
    refitted: int


def class_counts(df: DataFrame, label: str) -> tuple[list, np.ndarray]:
    """Sorted classes and their sizes: one row per class."""
    found = df.groupBy(quoted(label)).agg(F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: r[0])
    return [r[0] for r in found], np.array([r["n"] for r in found])


def loo_softmax(df: DataFrame, key: str, features: Sequence[str], label: str, c: float = 1.0) -> LooClasses:
    """Left-out class of every row, for any number of rows and three or more classes.

    Classes equal those of n separate refits. A row that is the only one of its class
    is judged by a fit that does not know the class, and marked ``lost_class``.
    """
    d = len(features)
    with reused(df.select(quoted(key), *map(quoted, features), quoted(label))) as kept:
        classes, counts = class_counts(kept, label)
        if len(classes) * (d + 1) > MAX_WEIGHTS:
            raise TooManyWeights(f"{len(classes)} classes of {d} features; use kfold_multinomial")
        if len(classes) < 3:
            raise ValueError("fewer than three classes, use loo_logistic")
        rows = _model_rows(kept, features, label, classes, [F.col(quoted(key))])
        fit = fit_softmax(rows, d, classes, c, counts)
        inverse = np.linalg.inv(fit.hessian)
        judged = left_out_classes(rows, key, fit, inverse, max_difference(rows, fit, inverse))
        lone = [float(i) for i, n in enumerate(counts) if n == 1]
        todo = judged.where(~F.col("certain") & ~F.col("y").isin(lone)).select(quoted(key), *fit.features, "y")
        refits, n_refits = _refits(rows, todo, key, fit)
        lost = [_without_class(rows, key, fit, int(code)) for code in lone]
    # The result is computed from the caller's frame when it is read, not from the kept one.
    rows = _model_rows(df, features, label, classes, [F.col(quoted(key))])
    judged = left_out_classes(rows, key, fit, inverse, 1.0).select(quoted(key), "y", "pick", "p")
    if lost:
        extra = df.sparkSession.createDataFrame(lost, _refit_schema(rows, key))
        refits = extra if refits is None else refits.unionByName(extra)
        n_refits += len(lost)
    if refits is not None:
        small = F.broadcast(refits) if n_refits <= BROADCAST_ROWS else refits
        judged = judged.join(small, key, "left")
    else:
        judged = judged.withColumns({"pick_exact": F.lit(None).cast("int"), "p_exact": F.lit(None).cast("double")})
    names = F.array(*[F.lit(v) for v in classes])
    predictions = judged.select(
        quoted(key),
        F.get(names, F.col("y").cast("int")).alias("label"),
        F.get(names, F.coalesce("pick_exact", "pick")).alias("prediction"),
        F.coalesce("p_exact", "p").alias("p"),
        F.col("pick_exact").isNotNull().alias("refitted"),
        F.when(F.col("y").isin(lone), "lost_class").otherwise("ok").alias("status"),
    )
    return LooClasses(fit, predictions, n_refits)


def _refit_schema(rows: DataFrame, key: str) -> T.StructType:
    return T.StructType(
        [rows.schema[key], T.StructField("pick_exact", T.IntegerType()), T.StructField("p_exact", T.DoubleType())]
    )


def _refits(rows: DataFrame, todo: DataFrame, key: str, fit: SoftmaxFit) -> tuple[DataFrame | None, int]:
    """Refits of the rows of ``todo``, a bounded batch at a time, in key order."""
    spark, schema = rows.sparkSession, _refit_schema(rows, key)
    k, d1 = fit.size
    size = block_size((k * d1) ** 2)
    todo = todo.orderBy(quoted(key))
    done, last, folder = 0, None, None
    while True:
        rest = todo if last is None else todo.where(F.col(quoted(key)) > F.lit(last))
        batch = rest.limit(size).collect()
        done += len(batch)
        if batch:
            x = np.array([[r[f] for f in fit.features] for r in batch]).reshape(len(batch), d1 - 1)
            picks, p = refit_classes(rows, x, np.array([r["y"] for r in batch]), fit)
            values = [(r[key], int(i), float(v)) for r, i, v in zip(batch, picks, p, strict=True)]
            part = spark.createDataFrame(values, schema)
            if folder is None and len(batch) < size:
                return part, done
            folder = folder or scratch_folder(spark, "class-refits")
            part.write.mode("append").parquet(folder)
            last = batch[-1][key]
        if len(batch) < size:
            return (spark.read.schema(schema).parquet(folder) if folder else None), done


def _without_class(rows: DataFrame, key: str, fit: SoftmaxFit, code: int) -> tuple:
    """Key, class code and probability of the only row of a class, from the other classes."""
    d = len(fit.features)
    row = rows.where(F.col("y") == code).first()
    rest = [i for i in range(len(fit.classes)) if i != code]
    recoded = rows.where(F.col("y") != code).withColumn(
        "y", F.when(F.col("y") > code, F.col("y") - 1).otherwise(F.col("y"))
    )
    x = np.array([[*[row[f] for f in fit.features], 1.0]])
    if len(rest) == 2:
        model = mllib_model(recoded, fit.features, "y", fit.c, fit.n - 1, family="binomial")
        eta = float(x[0, :-1] @ model.coefficients.toArray() + model.intercept)
        p = np.array([1.0 / (1.0 + np.exp(eta)), 1.0 / (1.0 + np.exp(-eta))])
    else:
        other = fit_softmax(recoded, d, rest, fit.c, fit.counts[rest])
        p = _probabilities(x @ other.weights.T)[0]
    return (row[key], rest[int(p.argmax())], float(p.max()))


def kfold_softmax(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    k: int = 10,
    c: float = 1.0,
    fold: Column | None = None,
) -> DataFrame:
    """Out-of-fold class of every row; the k fits share every pass.

    Columns key, fold, label, prediction, p. Every class must occur outside each fold;
    otherwise, or with too many weights, use ``kfold_multinomial``.
    """
    d = len(features)
    by = (fold if fold is not None else fold_of(F.col(quoted(key)), k)).alias("fold")
    with reused(df.select(quoted(key), by, *map(quoted, features), quoted(label))) as kept:
        classes, counts = class_counts(kept, label)
        n_classes = len(classes)
        if n_classes * (d + 1) > MAX_WEIGHTS or k > block_size(_width(n_classes, d)):
            raise TooManyWeights(f"{n_classes} classes of {d} features in {k} folds; use kfold_multinomial")
        rows = _model_rows(kept, features, label, classes, [F.col(quoted(key)), F.col("fold")])
        sizes = np.zeros((k, n_classes))
        for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect():
            sizes[r["fold"], int(r["y"])] = r["n"]
        if (counts - sizes == 0).any():
            raise ValueError("a class lies within one fold, use kfold_multinomial")
        start = np.zeros((1, n_classes * (d + 1)))
        if start.size > WIDE:
            start = fit_softmax(rows, d, classes, c, counts).weights.reshape(1, -1)

        def sums_at(w: np.ndarray, index: np.ndarray) -> Sums:
            # All folds keep their place, so fold f skips its own rows.
            everyone = np.repeat(start, k, axis=0)
            everyone[index] = w
            s = softmax_sums(rows, everyone.reshape(k, n_classes, d + 1), "fold")
            return Sums(s.n[index], s.positives[index], s.loss[index], s.gradient[index], s.hessian[index])

        weights = newton(sums_at, np.repeat(start, k, axis=0), _ridge(n_classes, d, c), _anchor(n_classes, d))[0]
    weights = weights.reshape(k, n_classes, d + 1)
    rows = _model_rows(df.withColumn("fold", by), features, label, classes, [F.col(quoted(key)), F.col("fold")])
    return score_by_fold(rows, key, weights, classes)


def score_by_fold(rows: DataFrame, key: str, weights: np.ndarray, classes: list) -> DataFrame:
    """Class of every row under the weights of its own fold, in one scan."""
    d = weights.shape[2] - 1
    names = [key, "fold", "y"]
    columns = [*names, *[f"x{i}" for i in range(d)]]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            a = np.column_stack([*data[2:], np.ones(batch.num_rows)])
            p = _probabilities(np.einsum("mki,mi->mk", weights[data[0].astype(int)], a))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p.max(axis=1))],
                [*names, "pick", "p"],
            )

    narrow = rows.select(*map(quoted, columns))
    schema = T.StructType(
        [*narrow.schema.fields[:3], T.StructField("pick", T.IntegerType()), T.StructField("p", T.DoubleType())]
    )
    values = F.array(*[F.lit(v) for v in classes])
    return narrow.mapInArrow(judge, schema).select(
        quoted(key),
        "fold",
        F.get(values, F.col("y").cast("int")).alias("label"),
        F.get(values, F.col("pick")).alias("prediction"),
        "p",
    )
