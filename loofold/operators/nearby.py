"""Converged left-out scores of a logistic fit from one expansion of its gradient.

Leaving a row out moves the weights a little. Around the fit w the gradient over all rows is

    G(w + z) = sum over k < K of T_k[z^k] / k!,   T_k = sum over rows of sigma^(k)(eta) a^(k + 1),

and one pass adds up the tensors T_k, whose number of cells depends on the features only. The
left-out optimum of row i is where G(w + z) less the row's own term, which is taken exactly,
vanishes; Newton steps find it row by row without another look at the table.

What the expansion leaves out is bounded. With |z| the length of z under the Hessian H, and
S = sqrt(max q) |z|, which no score moves beyond, |sigma^(K)| <= C_K sigma' gives for the rest

    |R| <= exp(S) C_K / K! S^(K - 1) |z|,

and with curvature at least exp(-S) (1 - v q) H without the row, the true score lies within
2 sqrt(q) (|g| + |R|) exp(S) / (1 - v q), g being the gradient that the last step left. A row whose
bound is above ``SCORE_ERROR`` is left open, to be refitted over all rows. As the squares of |z| add up
to a bounded sum, the number of such rows does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement
from math import comb, factorial

import numpy as np
import pyarrow as pa
from numpy.polynomial import Polynomial
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loofold.functions.scalars import quoted
from loofold.operators.logistic import CHUNK_CELLS, LogisticFit, penalty, summed_blocks

SCORE_ERROR = 1e-11
"""Proven error of a left-out score that is taken from the expansion."""
CELLS = 4096
"""Numbers of an expansion; the Hessian is there whatever its size."""
MOST_TERMS = 10
MAX_STEPS = 60


def terms_of(d1: int) -> int:
    """How many tensors fit into ``CELLS``; two at least, the gradient and the Hessian."""
    terms, cells = 2, d1 + comb(d1 + 1, 2)
    while terms < MOST_TERMS and (cells := cells + comb(d1 + terms, terms + 1)) <= CELLS:
        terms += 1
    return terms


def slopes(terms: int) -> list[Polynomial]:
    """sigma^(k) / sigma' as polynomials in 1 - 2p, for k = 1 .. terms."""
    u, out = Polynomial([0, 1]), [Polynomial([1])]
    while len(out) < terms:
        out.append(u * out[-1] - (1 - u * u) / 2 * out[-1].deriv())
    return out


def largest(slope: Polynomial) -> float:
    """Bound of a polynomial over -1 .. 1: the largest on a fine grid and what it may rise between."""
    grid = np.linspace(-1, 1, 4001)
    return float(np.abs(slope(grid)).max() + 2.5e-4 * np.abs(slope.deriv().coef).sum())


def monomials(a: np.ndarray, degree: int) -> list[np.ndarray]:
    """Per degree 0 .. ``degree``, all products of that many columns, in order of combinations."""
    d1 = a.shape[1]
    out, ends = [np.ones((len(a), 1))], np.zeros(1, int)
    for _ in range(degree):
        last = out[-1]
        pairs = [(i, j) for i, end in enumerate(ends) for j in range(end, d1)]
        left, right = map(list, zip(*pairs, strict=True))
        out.append(last[:, left] * a[:, right])
        ends = np.array(right)
    return out


def probability(eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p and p (1 - p), without overflow."""
    e = np.exp(-np.abs(eta))
    return np.where(eta >= 0, 1.0, e) / (1.0 + e), e / (1.0 + e) ** 2


def tensors(rows: DataFrame, weights: np.ndarray, terms: int) -> list[dict[tuple[int, ...], float]]:
    """The cells of T_0 .. T_(terms - 1) by their sorted places, in one pass."""
    d1 = len(weights)
    shapes = slopes(terms)
    widths = [comb(d1 + k, k + 1) for k in range(terms)]
    ends = np.cumsum([0, *widths])

    def add_chunk(totals: np.ndarray, data: list[np.ndarray]) -> None:
        a = np.column_stack([*data[: d1 - 1], np.ones(len(data[-1]))])
        p, v = probability(a @ weights)
        for k, products in enumerate(monomials(a, terms)[1:]):
            share = v * shapes[k - 1](1.0 - 2.0 * p) if k else p - data[-1]
            totals[0, ends[k] : ends[k + 1]] += share @ products

    names = [*[f"x{i}" for i in range(d1 - 1)], "y"]
    sums = summed_blocks(rows.select(*names), add_chunk, 1, int(ends[-1]), 2 * int(ends[-1]))[0]
    return [
        dict(zip(combinations_with_replacement(range(d1), k + 1), sums[ends[k] : ends[k + 1]].tolist(), strict=True))
        for k in range(terms)
    ]


class Expansion:
    """The gradient around a fit, as coefficients of the monomials of a move."""

    def __init__(self, rows: DataFrame, fit: LogisticFit):
        d1 = len(fit.weights)
        self.weights, self.terms = fit.weights, terms_of(d1)
        cells = tensors(rows, fit.weights, self.terms)
        ridge = penalty(d1 - 1, fit.c)
        coefficients = []
        for k, tensor in enumerate(cells):
            for places in combinations_with_replacement(range(d1), k):
                share = 1.0
                for i in set(places):
                    share /= factorial(places.count(i))
                coefficients.append([share * tensor[tuple(sorted((*places, i)))] for i in range(d1)])
        self.coefficients = np.array(coefficients)
        self.coefficients[0] += ridge * fit.weights
        self.coefficients[1 : d1 + 1] += np.diag(ridge)
        self.hessian = self.coefficients[1 : d1 + 1]
        self.inverse = np.linalg.inv(self.hessian)
        self.rest = largest(slopes(self.terms)[-1]) / factorial(self.terms)

    def gradient(self, z: np.ndarray) -> np.ndarray:
        return np.concatenate(monomials(z, self.terms - 1), axis=1) @ self.coefficients

    def left_out(self, a: np.ndarray, y: np.ndarray, max_q: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score after the first Newton step, converged score, and the bound of its error, by row."""
        eta, z = a @ self.weights, np.zeros_like(a)
        turned = a @ self.inverse
        q = np.einsum("ij,ij->i", turned, a)
        free = 1.0 - probability(eta)[1] * q
        first, size = np.zeros(len(a)), np.full(len(a), np.inf)
        live = np.arange(len(a))
        for step in range(MAX_STEPS):
            own = probability(eta[live] + np.einsum("ij,ij->i", a[live], z[live]))[0] - y[live]
            g = self.gradient(z[live]) - own[:, None] * a[live]
            down = g @ self.inverse
            now = np.sqrt(np.maximum(np.einsum("ij,ij->i", down, g), 0.0))
            better = now < size[live]  # false also where it is not a number
            size[live] = np.where(better, now, size[live])
            live, g, down = live[better], g[better], down[better]
            along = np.einsum("ij,ij->i", a[live], down) * (1.0 - free[live]) / (q[live] * free[live])
            move = down + turned[live] * along[:, None]
            z_next = z[live] - move
            if step == 0:
                first[live] = eta[live] + np.einsum("ij,ij->i", a[live], z_next)
            done = now[better] <= 1e-3 * SCORE_ERROR * free[live] / np.sqrt(q[live])
            live, z_next = live[~done], z_next[~done]
            if not len(live):
                break
            z[live] = z_next
        length = np.sqrt(np.maximum(np.einsum("ij,ij->i", z @ self.hessian, z), 0.0))
        moved = np.sqrt(max_q) * length
        off = size + np.exp(moved) * self.rest * moved ** (self.terms - 1) * length
        off *= np.exp(moved) / free
        proven = (free > 0) & (np.sqrt(max_q) * off <= 0.75)
        bound = np.where(proven, 2.0 * np.sqrt(q) * off, np.inf)
        return first, eta + np.einsum("ij,ij->i", a, z), bound


def nearby_scores(rows: DataFrame, key: str, expansion: Expansion, max_q: float) -> DataFrame:
    """The model rows with ``eta_loo`` after one step and the converged ``eta_near``, null where it is not proven."""
    d = len(expansion.weights) - 1
    names = [key, "y", *[f"x{i}" for i in range(d)]]
    chunk = max(1, CHUNK_CELLS // (4 * len(expansion.coefficients)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                batch = whole.slice(at, chunk)
                y, *x = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
                a = np.column_stack([*x, np.ones(batch.num_rows)])
                with np.errstate(all="ignore"):
                    first, eta, bound = expansion.left_out(a, y, max_q)
                    near = pa.array(eta, mask=~(bound <= SCORE_ERROR))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first), near], [*names, "eta_loo", "eta_near"])

    narrow = rows.select(*map(quoted, names))
    more = [T.StructField("eta_loo", T.DoubleType()), T.StructField("eta_near", T.DoubleType())]
    return narrow.mapInArrow(measure, T.StructType([*narrow.schema.fields, *more]))


def largest_q(rows: DataFrame, expansion: Expansion) -> float:
    """The largest a' H^-1 a of all rows."""
    inverse, d = expansion.inverse, len(expansion.weights) - 1

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = 0.0
        for batch in batches:
            a = np.column_stack([*[c.to_numpy(zero_copy_only=False) for c in batch.columns], np.ones(batch.num_rows)])
            top = max(top, float(np.einsum("ij,ij->i", a @ inverse, a).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([top])], ["q"])

    return rows.select(*[f"x{i}" for i in range(d)]).mapInArrow(highest, "q double").agg(F.max("q")).first()[0]
