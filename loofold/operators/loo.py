"""Leave-one-out and k-fold evaluation of the logistic model.

Refitting once per row costs n passes. Instead, one converged fit and its Hessian H
give every row's left-out score by a rank-one downdate: with a = [x, 1], v = p(1-p),
q = a' H^-1 a and t = (p - y) / (1 - v q),

    eta_loo = eta + q t.

That is the first Newton step of the refit without the row. How far the refit can still
move is bounded row by row, because the third derivative of the log-loss is never larger
than the second. Along the step no score moves by more than s = sqrt(max q * q) |t|, so
curvature changes by a factor within exp(-s) .. exp(s); that bounds the gradient left
after the step, and the gradient bounds the way to the optimum:

    |eta_refit - eta_loo| <= sqrt(q / max q) * -ln(1 - exp(s) (exp(s) - 1 - s)).

For s <= 3/4 the logarithm is at most s^2 / 2 * exp(2.24 s). A row whose score is farther
from the threshold than this keeps its class for certain. All other rows are refitted
exactly, many per pass. The bound shrinks like 1/n^2, so on large tables few rows or
none are left.

Where scores are asked for and not only classes, ``nearby`` gives the converged left-out optimum of
nearly every row from sums of higher order, with a proven error; the others are refitted likewise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loofold.functions.scalars import linear_predictor, quoted, sigmoid
from loofold.operators.linear import NARROW, quadratic_form
from loofold.operators.logistic import (
    WIDE,
    LogisticFit,
    SingleClass,
    Sums,
    block_size,
    fit_logistic,
    fold_sums,
    mllib_start,
    model_rows,
    newton,
    penalty,
    sums_width,
)
from loofold.operators.nearby import Expansion, largest_q, nearby_scores
from loofold.operators.split import fold_of
from loofold.session import scratch_folder, written_table

ROUND_OFF = 1e-9
"""Error that the converged weights leave in a score."""
STEP_ERROR = 1e-4
"""Relative error of the left-out step; the Hessian belongs to weights one tiny step back."""
EXACT_WORK = 100_000_000
"""Row-fold pairs that exact leave-one-out may cost: rows times refits over all of them, and two passes."""
BROADCAST_ROWS = 100_000


class TooMuchWork(ValueError):
    """Exact leave-one-out would visit too many (row, fold) pairs."""


@dataclass
class LooResult:
    fit: LogisticFit | None
    predictions: DataFrame
    """key, label, eta, p, prediction, refitted, status."""
    refitted: int


@contextmanager
def reused(df: DataFrame, persist: bool = True):
    """Keep a frame that several passes read; spills to disk and recomputes lost blocks."""
    if not persist:
        yield df
        return
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def scored_rows(rows: DataFrame, key: str, fit: LogisticFit, inverse: np.ndarray) -> DataFrame:
    """The model rows with eta and q."""
    d = len(fit.features)
    if d < NARROW:
        a = [*[F.col(f"x{i}") for i in range(d)], F.lit(1.0)]
        eta = linear_predictor(a[:-1], fit.coefficients, fit.intercept)
        return rows.select("*", eta.alias("eta"), quadratic_form(a, inverse).alias("q"))
    weights = fit.weights
    names = [key, "y", *[f"x{i}" for i in range(d)]]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]
            a = np.column_stack([*x, np.ones(batch.num_rows)])
            eta = a @ weights
            q = np.einsum("ij,ij->i", a @ inverse, a)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(eta), pa.array(q)], [*names, "eta", "q"]
            )

    narrow = rows.select(*map(quoted, names))
    schema = T.StructType([*narrow.schema.fields, T.StructField("eta", T.DoubleType()), T.StructField("q", T.DoubleType())])
    return narrow.mapInArrow(measure, schema)


def left_out(scored: DataFrame) -> DataFrame:
    """Adds the signed step t and the first-step left-out score."""
    return (
        scored.withColumn("p0", 1.0 / (1.0 + F.exp(-F.col("eta"))))
        .withColumn("t", F.expr("(p0 - y) / greatest(1D - p0 * (1D - p0) * q, 1e-12D)"))
        .withColumn("eta_loo", F.expr("eta + q * t"))
    )


def is_certain(max_q: float) -> Column:
    """True where the bound proves the class of the left-out refit."""
    s = f"(sqrt({max_q!r}D * q) * abs(t))"
    return F.expr(
        f"{s} <= 0.75D AND abs(eta_loo) > "
        f"0.5D * sqrt(q / {max_q!r}D) * {s} * {s} * exp(2.24D * {s}) "
        f"+ {STEP_ERROR!r}D * abs(q * t) + {ROUND_OFF!r}D"
    )


def refit_folds(
    rows: DataFrame, held_out: np.ndarray, labels: np.ndarray, fit: LogisticFit
) -> np.ndarray:
    """Exact left-out scores of the given rows, in as many shared passes as Newton needs.

    Every pass adds up all rows at each fold's weights; the one row that a fold leaves
    out is known here and taken off again.
    """
    a = np.column_stack([held_out, np.ones(len(labels))])

    def sums_at(w: np.ndarray, index: np.ndarray) -> Sums:
        s = fold_sums(rows, w)
        out, y = a[index], labels[index]
        eta = np.einsum("ij,ij->i", out, w)
        p = 1.0 / (1.0 + np.exp(-eta))
        return Sums(
            s.n - 1,
            s.positives - y,
            s.loss - (np.logaddexp(0.0, eta) - y * eta),
            s.gradient - (p - y)[:, None] * out,
            s.hessian - (p * (1 - p))[:, None, None] * out[:, :, None] * out[:, None, :],
        )

    # The first step from the full fit needs no pass: its sums are known.
    p = 1.0 / (1.0 + np.exp(-(a @ fit.weights)))
    v = p * (1.0 - p)
    down = fit.hessian - v[:, None, None] * a[:, :, None] * a[:, None, :]
    start = fit.weights + np.linalg.solve(down, ((p - labels)[:, None] * a)[:, :, None])[:, :, 0]
    best, _, _, _ = newton(sums_at, start, penalty(len(fit.features), fit.c))
    return np.einsum("ij,ij->i", a, best)


def _refit_in_batches(
    rows: DataFrame, todo: DataFrame, key: str, fit: LogisticFit
) -> tuple[DataFrame | None, int]:
    """Refit without each row of ``todo``, a bounded batch at a time, in key order.

    The driver holds one batch. When there is more than one, results are written out as
    they come and read back as a table.
    """
    spark = rows.sparkSession
    features = [f"x{i}" for i in range(len(fit.features))]
    size = block_size((len(features) + 1) ** 2)
    schema = T.StructType([rows.schema[key], T.StructField("eta_exact", T.DoubleType())])
    todo = todo.select(quoted(key), "y", *features).orderBy(quoted(key))
    done, last, folder = 0, None, None
    while True:
        rest = todo if last is None else todo.where(F.col(quoted(key)) > F.lit(last))
        batch = rest.limit(size).collect()
        done += len(batch)
        if batch:
            x = np.array([[r[f] for f in features] for r in batch]).reshape(len(batch), len(features))
            eta = refit_folds(rows, x, np.array([r["y"] for r in batch]), fit)
            part = spark.createDataFrame([(r[key], float(e)) for r, e in zip(batch, eta, strict=True)], schema)
            if folder is None and len(batch) < size:
                return part, done
            folder = folder or scratch_folder(spark, "refits")
            part.write.mode("append").parquet(folder)
            last = batch[-1][key]
        if len(batch) < size:
            return (spark.read.schema(schema).parquet(folder) if folder else None), done


def _finish(
    base: DataFrame, key: str, refits: DataFrame | None, n_refits: int, positives: int, n: int
) -> DataFrame:
    """Columns of the result; rows whose removal leaves one class get that class.

    ``eta`` and ``p`` are those of the refit, or null where a row was not refitted; the first
    Newton step, which settled the class there, is ``eta_step``.
    """
    eta = F.col("eta_near") if "eta_near" in base.columns else F.lit(None).cast("double")
    if refits is not None:
        small = F.broadcast(refits) if n_refits <= BROADCAST_ROWS else refits
        base = base.join(small, key, "left")
        eta = F.coalesce("eta_exact", eta)
    refitted = eta.isNotNull()
    lone = F.lit(False)
    if positives == 1:
        lone = F.col("y") == 1
    if n - positives == 1:
        lone = lone | (F.col("y") == 0)
    rest = 1 - F.col("y").cast("int")
    return (
        base.withColumn("eta", F.when(~lone, eta))
        .withColumn("refitted", refitted & ~lone)
        .select(
            quoted(key),
            F.col("y").cast("int").alias("label"),
            "eta",
            F.when(lone, rest.cast("double")).otherwise(sigmoid(F.col("eta"))).alias("p"),
            F.when(lone, rest).otherwise((F.coalesce("eta", "eta_loo") >= 0).cast("int")).alias("prediction"),
            "refitted",
            F.when(~lone, F.col("eta_loo")).alias("eta_step"),
            F.when(lone, "single_class").otherwise("ok").alias("status"),
        )
    )


def _one_class(rows: DataFrame, key: str, label: int) -> LooResult:
    predictions = rows.select(
        quoted(key),
        F.col("y").cast("int").alias("label"),
        F.lit(None).cast("double").alias("eta"),
        F.lit(float(label)).alias("p"),
        F.lit(label).alias("prediction"),
        F.lit(False).alias("refitted"),
        F.lit(None).cast("double").alias("eta_step"),
        F.lit("single_class").alias("status"),
    )
    return LooResult(None, predictions, 0)


def loo_logistic(
    df: DataFrame, key: str, features: Sequence[str], label: str, c: float = 1.0, persist: bool = True
) -> LooResult:
    """Left-out class of every row, for any number of rows.

    ``key`` must be unique. Classes equal those of n separate refits; ``eta`` and ``p`` are
    given where ``refitted`` and null elsewhere, where the step in ``eta_step`` is enough for
    the class (``loo_exact`` gives them for every row). After the fit there are two
    more passes over the narrow model frame, and a few for refits if any; none of them
    shuffles rows. ``persist=False`` is for a frame that is cheap to read, as a table.
    """
    rows = model_rows(df, features, label, [key])
    with reused(rows, persist):
        try:
            fit = fit_logistic(rows, [f"x{i}" for i in range(len(features))], "y", c)
        except SingleClass as e:
            return _one_class(rows, key, e.label)
        base = left_out(scored_rows(rows, key, fit, np.linalg.inv(fit.hessian)))
        max_q = base.agg(F.max("q")).first()[0]
        lone = [float(i) for i, k in ((1, fit.positives), (0, fit.n - fit.positives)) if k == 1]
        open_rows = base.where(~is_certain(max_q) & ~F.col("y").isin(lone))
        refits, n_refits = _refit_in_batches(rows, open_rows, key, fit)
    fit.features, fit.label = list(features), label
    return LooResult(fit, _finish(base, key, refits, n_refits, fit.positives, fit.n), n_refits)


def loo_exact(
    df: DataFrame, key: str, features: Sequence[str], label: str, c: float = 1.0, limit: int = EXACT_WORK
) -> LooResult:
    """Every row refitted without itself, scores converged, for any number of rows.

    Newton steps against an expansion of the gradient around the fit (``nearby``) converge row by
    row, with an error proven to be below ``nearby.SCORE_ERROR``. Rows whose removal moves the fit too far
    for that proof are refitted over the whole table; their number depends on the data's outliers
    and not on its rows. Work above ``limit`` is refused, not cut.
    """
    rows = model_rows(df, features, label, [key])
    with reused(rows):
        try:
            fit = fit_logistic(rows, [f"x{i}" for i in range(len(features))], "y", c)
        except SingleClass as e:
            return _one_class(rows, key, e.label)
        expansion = Expansion(rows, fit)
        base = written_table(nearby_scores(rows, key, expansion, largest_q(rows, expansion)), "left-out")
        lone = [float(i) for i, k in ((1, fit.positives), (0, fit.n - fit.positives)) if k == 1]
        open_rows = base.where(F.col("eta_near").isNull() & ~F.col("y").isin(lone))
        n_open = open_rows.count()
        if fit.n * (2 + n_open) > limit:
            raise TooMuchWork(f"{n_open} refits over {fit.n} rows; use loo_logistic or kfold_logistic")
        refits, n_refits = _refit_in_batches(rows, open_rows, key, fit)
    fit.features, fit.label = list(features), label
    return LooResult(fit, _finish(base, key, refits, n_refits, fit.positives, fit.n), fit.n - len(lone))


@dataclass
class KFoldResult:
    weights: np.ndarray
    predictions: DataFrame
    """key, fold, label, eta, p, prediction, status."""


def kfold_logistic(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    k: int = 10,
    c: float = 1.0,
    fold: Column | None = None,
) -> KFoldResult:
    """Out-of-fold scores of k converged fits that share every pass."""
    d = len(features)
    if k > block_size(sums_width(d)):
        raise ValueError(f"at most {block_size(sums_width(d))} folds for {d} features")
    assigned = df.withColumn("__fold", fold if fold is not None else fold_of(F.col(quoted(key)), k))
    rows = model_rows(assigned, features, label, [key, "__fold"])
    with reused(rows):
        counts = rows.groupBy("__fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).collect()
        n, s = np.zeros(k), np.zeros(k)
        for r in counts:
            n[r["__fold"]], s[r["__fold"]] = r["n"], r["s"]
        train_n, train_s = n.sum() - n, s.sum() - s
        fits = np.flatnonzero((train_s > 0) & (train_s < train_n))
        weights = np.zeros((k, d + 1))
        if len(fits):
            names = [f"x{i}" for i in range(d)]
            start = mllib_start(rows, names, "y", c) if d > WIDE else np.zeros(d + 1)
            # Folds that need no fit keep their place, so fold k still skips its own rows.
            def sums_at(w: np.ndarray, index: np.ndarray) -> Sums:
                everyone = np.zeros((k, d + 1))
                everyone[fits[index]] = w
                full = fold_sums(rows, everyone, "__fold")
                pick = fits[index]
                return Sums(
                    full.n[pick], full.positives[pick], full.loss[pick], full.gradient[pick], full.hessian[pick]
                )

            weights[fits] = newton(sums_at, np.repeat(start[None], len(fits), axis=0), penalty(d, c))[0]
    single = {int(f): int(train_s[f] > 0) for f in range(k) if f not in fits}
    eta = F.lit(None).cast("double")
    only = F.lit(None).cast("int")
    by_fold = F.col("__fold")
    per_fold = F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in weights])
    if d < NARROW:
        w = F.get(per_fold, by_fold)
        eta = F.get(w, F.lit(d))
        for i in range(d):
            eta = eta + F.get(w, F.lit(i)) * F.col(f"x{i}")
    else:
        eta = F.aggregate(
            F.zip_with(F.get(per_fold, by_fold), F.array(*[F.col(f"x{i}") for i in range(d)], F.lit(1.0)),
                       lambda a, b: a * b),
            F.lit(0.0),
            lambda acc, t: acc + t,
        )
    for f, value in single.items():
        only = F.when(by_fold == f, value).otherwise(only)
    predictions = (
        rows.withColumn("only", only)
        .withColumn("eta", F.when(F.col("only").isNull(), eta))
        .select(
            quoted(key),
            by_fold.alias("fold"),
            F.col("y").cast("int").alias("label"),
            "eta",
            F.coalesce(sigmoid(F.col("eta")), F.col("only").cast("double")).alias("p"),
            F.coalesce((F.col("eta") >= 0).cast("int"), F.col("only")).alias("prediction"),
            F.when(F.col("only").isNull(), "ok").otherwise("single_class").alias("status"),
        )
    )
    return KFoldResult(weights, predictions)
