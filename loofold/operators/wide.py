"""Logistic models of any width: matrix-free Newton steps by conjugate gradients.

Rows are sparse: the places and values of their features. No Hessian is built; a pass over the rows
multiplies it with a vector, and conjugate gradients solve each Newton step from such passes.
Systems that need solving at the same time (several fits, folds, or right-hand sides) share every
pass; a pass moves a few vectors of the model's length.

Leave-one-out takes q = a' H^-1 a of a row from a solve with the row as right-hand side, a block of
distinct rows at once. A row that occurs c times needs none if its class is safe with
q <= 1 / (c v), which holds since c copies alone put c v a a' into H. With q, the bound of
``loo.py`` tells which classes are certain; the others are refitted without the row, a block of fits
sharing passes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loofold.functions.scalars import quoted, sigmoid
from loofold.operators.logistic import MAX_PASSES, MISSING, NotConverged, SingleClass
from loofold.operators.loo import ROUND_OFF, STEP_ERROR, LooResult, reused
from loofold.operators.prep import PrepModel
from loofold.operators.sums import summed
from loofold.session import scratch_folder

SOLVE_CELLS = 2_000_000
"""Numbers of all vectors of a block of systems, as the driver and each task hold them."""
SOLVED = 1e-11
"""Relative residual at which a solve ends."""
STILL = 1e-9
"""A Newton step this small is the last one."""
LARGE_Q = 1.0
"""Rows whose copies bound q only above this get it by a solve."""


def sparse_rows(
    df: DataFrame, prep: PrepModel, label: Column, keep: Sequence[str] = ()
) -> tuple[DataFrame, int]:
    """Kept columns, ``at`` and ``value`` (places and values of features) and ``y``; and the width.

    Places follow ``prep.feature_names``: scaled numbers, then one place per level. A level that the
    preparation does not know has no place.
    """
    n = len(prep.numeric)
    places, values, begin = [F.lit(i) for i in range(n)], [prep.scaled(c) for c in prep.numeric], n
    for name, stats in prep.categorical.items():
        levels = F.array(*[F.lit(v) for v in stats.levels])
        nth = F.array_position(levels, prep.imputed(name)).cast("int")
        places.append(F.when(nth > 0, nth - 1 + begin))
        values.append(F.lit(1.0))
        begin += len(stats.levels)
    pairs = F.filter(F.arrays_zip(F.array(*places).alias("at"), F.array(*values).alias("value")), lambda p: p["at"].isNotNull())
    rows = df.select(*[F.col(quoted(c)) for c in keep], pairs.alias("pairs"), label.cast("double").alias("y"))
    return rows.select(*[F.col(quoted(c)) for c in keep], F.col("pairs.at").alias("at"), F.col("pairs.value").alias("value"), "y"), begin


@dataclass
class Sparse:
    """Rows of a batch: where each begins, places, values, labels."""

    bounds: np.ndarray
    at: np.ndarray
    value: np.ndarray
    y: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, at: pa.Array, value: pa.Array, y: pa.Array) -> Sparse:
        sizes = pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.append(0, np.cumsum(sizes))
        return cls(
            bounds,
            at.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
            value.flatten().to_numpy(zero_copy_only=False).astype(float),
            y.to_numpy(zero_copy_only=False).astype(float),
            np.repeat(np.arange(len(sizes)), sizes),
        )

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Scores of all rows; the last weight is the intercept."""
        return np.bincount(self.owner, w[self.at] * self.value, minlength=len(self.y)) + w[-1]

    def spread(self, r: np.ndarray, width: int) -> np.ndarray:
        """Sum of rows, each times its number in ``r``."""
        out = np.bincount(self.at, r[self.owner] * self.value, minlength=width)
        out[-1] += r.sum()
        return out

    def squares(self, v: np.ndarray, width: int) -> np.ndarray:
        out = np.bincount(self.at, v[self.owner] * self.value**2, minlength=width)
        out[-1] += v.sum()
        return out


def _probability(eta: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))


class Systems:
    """Passes over the rows for K weight vectors, of which vector k may leave one row out."""

    def __init__(self, rows: DataFrame, width: int, ridge: np.ndarray, held: Sparse | None = None):
        self.rows, self.width, self.ridge, self.held = rows.select("at", "value", "y"), width, ridge, held
        self.passes = 0

    def _summed(self, add: Callable[[np.ndarray, Sparse], None], size: int) -> np.ndarray:
        self.passes += 1
        return summed(self.rows, lambda totals, batch: add(totals, Sparse.of(*batch.columns)), size)

    def gradients(self, weights: np.ndarray, index: np.ndarray):
        """Loss, gradient and Hessian diagonal per vector, penalties included; rows and positive ones."""
        k, width, held, ridge = len(weights), self.width, self.held, self.ridge

        def add(totals: np.ndarray, some: Sparse) -> None:
            totals[-2:] += len(some.y), some.y.sum()
            for i, row in enumerate(totals[:-2].reshape(k, -1)):
                eta = some.dot(weights[i])
                p = _probability(eta)
                row[0] += (np.logaddexp(0.0, eta) - some.y * eta).sum()
                row[1 : 1 + width] += some.spread(p - some.y, width)
                row[1 + width :] += some.squares(p * (1 - p), width)

        flat = self._summed(add, k * (1 + 2 * width) + 2)
        table = flat[:-2].reshape(k, -1)
        if held is not None:
            for row, w, f in zip(table, weights, index, strict=True):
                one = _row(held, f)
                eta = one.dot(w)
                p = _probability(eta)
                row[0] -= np.logaddexp(0.0, eta)[0] - (one.y * eta)[0]
                row[1 : 1 + width] -= one.spread(p - one.y, width)
                row[1 + width :] -= one.squares(p * (1 - p), width)
        loss = table[:, 0] + 0.5 * (weights**2) @ ridge
        return loss, table[:, 1 : 1 + width] + ridge * weights, table[:, 1 + width :] + ridge, flat[-2:]

    def products(self, weights: np.ndarray, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Hessian at each weight vector times its vector; one weight vector may serve all."""
        k, width, one = len(vectors), self.width, len(weights) == 1

        def add(totals: np.ndarray, some: Sparse) -> None:
            v = None
            for i, row in enumerate(totals.reshape(k, -1)):
                if v is None or not one:
                    p = _probability(some.dot(weights[0 if one else i]))
                    v = p * (1 - p)
                row += some.spread(v * some.dot(vectors[i]), width)

        table = self._summed(add, k * width).reshape(k, width)
        if self.held is not None:
            for i, f in enumerate(index):
                some = _row(self.held, f)
                p = _probability(some.dot(weights[0 if one else i]))
                table[i] -= some.spread(p * (1 - p) * some.dot(vectors[i]), width)
        return table + self.ridge * vectors

    def solve(self, weights: np.ndarray, right: np.ndarray, diagonal: np.ndarray, index: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Conjugate gradients, scaled by the diagonal, until each residual is ``ends`` of its right side."""
        x = np.zeros_like(right)
        residual, scale = right.copy(), np.where(diagonal > 0, diagonal, 1.0)
        z = residual / scale
        direction, rz = z.copy(), (residual * z).sum(axis=1)
        goal = ends**2 * rz
        for _ in range(10 * self.width + 100):
            on = np.flatnonzero(rz > goal)
            if not len(on):
                return x
            product = self.products(weights if len(weights) == 1 else weights[on], direction[on], index[on])
            step = rz[on] / np.maximum((direction[on] * product).sum(axis=1), 1e-300)
            x[on] += step[:, None] * direction[on]
            residual[on] -= step[:, None] * product
            z = residual[on] / (scale if len(scale) == 1 else scale[on])
            new = (residual[on] * z).sum(axis=1)
            direction[on] = z + (new / rz[on])[:, None] * direction[on]
            rz[on] = new
        raise NotConverged("conjugate gradients did not end")

    def newton(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Optimal weights and Hessian diagonals, and the counts of rows and positive ones."""
        best, k = start.copy(), len(start)
        value, diagonal = np.full(k, np.inf), np.zeros_like(start)
        step, active = np.zeros_like(start), np.arange(k)
        for _ in range(MAX_PASSES):
            trial = best[active] + step[active]
            loss, gradient, curvature, counts = self.gradients(trial, active)
            if not np.isfinite(gradient).all():
                raise ValueError(MISSING)
            if self.held is None and counts[1] in (0, counts[0]):
                if not counts[0]:
                    raise ValueError("no rows to fit")
                raise SingleClass(int(counts[1] > 0))
            worse = loss > value[active] + 1e-12 * np.maximum(1.0, np.abs(loss))
            step[active[worse]] *= 0.5
            good = active[~worse]
            best[good], value[good], diagonal[good] = trial[~worse], loss[~worse], curvature[~worse]
            if len(good):
                g = gradient[~worse]
                ends = np.clip(np.abs(g).max(axis=1) * 1e-2, SOLVED, 0.1)
                step[good] = self.solve(best[good], -g, diagonal[good], good, ends)
            small = np.abs(step[active]).max(axis=1) <= STILL
            best[active[small]] += step[active[small]]
            active = active[~small]
            if not len(active):
                return best, diagonal, counts
        raise NotConverged(f"{len(active)} of {k} fits still move after {MAX_PASSES} steps")


def _row(some: Sparse, i: int) -> Sparse:
    a, b = some.bounds[i], some.bounds[i + 1]
    return Sparse(np.array([0, b - a]), some.at[a:b], some.value[a:b], some.y[i : i + 1], np.zeros(b - a, np.int64))


@dataclass
class WideFit:
    weights: np.ndarray
    """Coefficients, then the intercept."""
    diagonal: np.ndarray
    n: int
    positives: int
    passes: int

    def eta(self) -> Column:
        """Score of rows (at, value); the weights travel as one literal array."""
        w = F.array(*[F.lit(float(x)) for x in self.weights[:-1]])
        total = F.aggregate(F.zip_with("at", "value", lambda i, x: F.get(w, i) * x), F.lit(0.0), lambda a, b: a + b)
        return total + F.lit(float(self.weights[-1]))


def _ridge(d: int, c: float) -> np.ndarray:
    return np.append(np.full(d, 1.0 / c), 0.0)


def fit_wide(rows: DataFrame, d: int, c: float = 1.0) -> WideFit:
    """Converged L2 logistic fit of sparse rows (at, value, y) with ``d`` features.

    The driver holds a few vectors of length d. Cache or write ``rows`` first.
    """
    systems = Systems(rows, d + 1, _ridge(d, c))
    best, diagonal, counts = systems.newton(np.zeros((1, d + 1)))
    return WideFit(best[0], diagonal[0], int(counts[0]), int(counts[1]), systems.passes)


def _scored(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows with eta of the fit, by Arrow batches."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def measure(batches):
        for batch in batches:
            some = Sparse.of(*(batch.column(batch.schema.names.index(c)) for c in ("at", "value", "y")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(some.dot(shared.value))], [*batch.schema.names, "eta"])

    return rows.mapInArrow(measure, T.StructType([*rows.schema.fields, T.StructField("eta", T.DoubleType())]))


def _blocks(frame: DataFrame, size: int):
    """Rows (id, at, value, y) a block at a time in the order of ``id``, as batches on the driver."""
    last = None
    while True:
        rest = frame if last is None else frame.where(F.col("id") > F.lit(last))
        block = rest.orderBy("id").limit(size).toArrow().combine_chunks()
        if block.num_rows:
            yield block
            last = block.column("id")[-1].as_py()
        if block.num_rows < size:
            return


def _gathered(spark, found, schema: str) -> DataFrame:
    """Blocks of results as one table, each written as soon as it is known."""
    folder = None
    for part in found:
        folder = folder or scratch_folder(spark, "wide")
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder) if folder else spark.createDataFrame([], schema)


def _sparse_of(block: pa.Table) -> Sparse:
    batch = block.to_batches()[0]
    return Sparse.of(*(batch.column(batch.schema.names.index(c)) for c in ("at", "value", "y")))


def leverages(rows: DataFrame, wanted: DataFrame, fit: WideFit, c: float) -> DataFrame:
    """id and q = a' H^-1 a of the distinct rows ``wanted`` (id, at, value, y), block by block."""
    width = len(fit.weights)
    systems = Systems(rows, width, _ridge(width - 1, c))

    def found():
        for block in _blocks(wanted, max(1, SOLVE_CELLS // width)):
            some = _sparse_of(block)
            right = np.stack([_row(some, i).spread(np.ones(1), width) for i in range(len(some.y))])
            x = systems.solve(fit.weights[None], right, fit.diagonal[None], np.arange(len(right)), np.full(len(right), 1e-7))
            yield list(zip(block.column("id").to_pylist(), (x * right).sum(axis=1).tolist(), strict=True))

    return _gathered(rows.sparkSession, found(), "id string, q double")


def refitted(rows: DataFrame, wanted: DataFrame, fit: WideFit, c: float) -> DataFrame:
    """id and the converged left-out score of each of ``wanted`` (id, at, value, y), block by block."""
    width = len(fit.weights)

    def found():
        for block in _blocks(wanted, max(1, SOLVE_CELLS // (3 * width))):
            held = _sparse_of(block)
            best, *_ = Systems(rows, width, _ridge(width - 1, c), held).newton(np.repeat(fit.weights[None], len(held.y), axis=0))
            eta = [float(_row(held, i).dot(w)[0]) for i, w in enumerate(best)]
            yield list(zip(block.column("id").to_pylist(), eta, strict=True))

    return _gathered(rows.sparkSession, found(), "id string, eta_exact double")


def _reach(q: str, most: float) -> str:
    """How far a left-out score may lie from ``eta`` if q is at most that, as SQL; null where unknown."""
    t = f"(abs(p0 - y) / greatest(1D - p0 * (1D - p0) * {q}, 1e-12D))"
    s = f"(sqrt({most!r}D * {q}) * {t})"
    rest = f"0.5D * sqrt({q} / {most!r}D) * {s} * {s} * exp(2.24D * {s}) + {STEP_ERROR!r}D * {q} * {t} + {ROUND_OFF!r}D"
    return f"if({s} <= 0.75D, {rest}, NULL)"


def loo_wide(rows: DataFrame, key: str, d: int, c: float = 1.0) -> LooResult:
    """Left-out class of every sparse row (key, at, value, y), as ``loo_logistic`` gives it.

    Equal feature lists share a solve, so a table of n rows with m distinct ones costs about
    m / block solves at most, and fewer where copies settle the class. ``key`` must be unique.
    """
    rows = rows.select(quoted(key), "at", "value", "y")
    with reused(rows):
        try:
            fit = fit_wide(rows, d, c)
        except SingleClass as e:
            predictions = rows.select(
                quoted(key), F.col("y").cast("int").alias("label"), F.lit(None).cast("double").alias("eta"),
                F.lit(float(e.label)).alias("p"), F.lit(e.label).alias("prediction"), F.lit(False).alias("refitted"),
                F.lit(None).cast("double").alias("eta_step"), F.lit("single_class").alias("status"),
            )
            return LooResult(None, predictions, 0)
        vector = F.sha2(F.concat_ws("|", F.concat_ws(",", F.transform("at", lambda x: x.cast("string"))),
                                    F.concat_ws(",", F.transform("value", lambda x: x.cast("string")))), 256)
        scored = _scored(rows.withColumn("vector", vector), fit.weights).withColumn("p0", sigmoid(F.col("eta")))
        with reused(scored):
            # Rows without a label of the other class left are settled by that alone.
            lone = [float(i) for i, k in ((1, fit.positives), (0, fit.n - fit.positives)) if k == 1]
            kinds = scored.groupBy("vector").agg(F.count("*").alias("copies"), F.first("at").alias("at"), F.first("value").alias("value"), F.first("p0").alias("p0"))
            kinds = kinds.withColumn("most_q", F.expr("1D / greatest(copies * p0 * (1D - p0), 1e-300)"))
            open_kinds = (
                scored.join(kinds.select("vector", "most_q"), "vector")
                .where((F.col("most_q") > LARGE_Q) | F.expr(f"NOT coalesce(abs(eta) > most_q * abs(p0 - y) / greatest(1D - p0 * (1D - p0) * most_q, 1e-12D) + {_reach('most_q', LARGE_Q)}, false)"))
                .select("vector").distinct()
            )
            wanted = kinds.join(open_kinds, "vector").select(F.col("vector").alias("id"), "at", "value", F.lit(0.0).alias("y"))
            solved = leverages(rows, wanted, fit, c)
            most = max(LARGE_Q, solved.agg(F.max("q")).first()[0] or 0.0)
            if most > LARGE_Q:  # the copies' bound must hold at the largest q as well
                settled = F.expr(f"coalesce(abs(eta) > most_q * abs(p0 - y) / greatest(1D - p0 * (1D - p0) * most_q, 1e-12D) + {_reach('most_q', most)}, false)")
                again = scored.join(kinds.select("vector", "most_q"), "vector").join(solved.select(F.col("id").alias("vector")), "vector", "left_anti").where(~settled)
                again = kinds.join(again.select("vector").distinct(), "vector").select(F.col("vector").alias("id"), "at", "value", F.lit(0.0).alias("y"))
                solved = solved.unionByName(leverages(rows, again, fit, c))
            base = (
                scored.join(solved.withColumnRenamed("id", "vector"), "vector", "left")
                .withColumn("t", F.expr("(p0 - y) / greatest(1D - p0 * (1D - p0) * q, 1e-12D)"))
                .withColumn("eta_loo", F.expr("eta + q * t"))
            )
            certain = F.expr(f"q IS NULL OR coalesce(abs(eta_loo) > {_reach('q', most)}, false)")
            todo = base.where(~certain & ~F.col("y").isin(lone)).select(F.col(quoted(key)).cast("string").alias("id"), "at", "value", "y")
            refits = refitted(rows, todo, fit, c)
            n_refits = refits.count()
        base = base.join(refits, F.col(quoted(key)).cast("string") == F.col("id"), "left")
    alone = F.col("y").isin(lone) if lone else F.lit(False)
    rest = 1 - F.col("y").cast("int")
    predictions = base.withColumn("eta_found", F.when(~alone, F.col("eta_exact"))).select(
        quoted(key),
        F.col("y").cast("int").alias("label"),
        F.col("eta_found").alias("eta"),
        F.when(alone, rest.cast("double")).otherwise(sigmoid(F.col("eta_found"))).alias("p"),
        F.when(alone, rest).otherwise((F.coalesce("eta_exact", "eta_loo", "eta") >= 0).cast("int")).alias("prediction"),
        (F.col("eta_exact").isNotNull() & ~alone).alias("refitted"),
        F.when(~alone, F.col("eta_loo")).alias("eta_step"),
        F.when(alone, "single_class").otherwise("ok").alias("status"),
    )
    return LooResult(fit, predictions, n_refits)
