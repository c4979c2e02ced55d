"""Plain refits of small tables, to check the distributed results against."""

from __future__ import annotations

import numpy as np


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0) -> np.ndarray:
    a = np.column_stack([x, np.ones(len(y))])
    ridge = np.append(np.full(x.shape[1], 1.0 / c), 0.0)

    def value(w):
        eta = a @ w
        return np.sum(np.logaddexp(0, eta) - y * eta) + 0.5 * ridge @ (w * w)

    w = np.zeros(a.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a @ w)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
        scale = 1.0
        while value(w - scale * step) > value(w) + 1e-12 and scale > 1e-9:
            scale /= 2
        w = w - scale * step
        if np.abs(step).max() < 1e-12:
            break
    return w


def softmax(x: np.ndarray, y: np.ndarray, k: int, c: float = 1.0) -> np.ndarray:
    m, d = x.shape
    a = np.column_stack([x, np.ones(m)])
    ridge = np.tile(np.append(np.full(d, 1.0 / c), 0.0), k)
    shift = np.tile(np.append(np.zeros(d), 1.0), k)
    w = np.zeros((k, d + 1))
    for _ in range(100):
        p = probabilities(a @ w.T)
        g = p.copy()
        g[np.arange(m), y] -= 1
        gradient = (g.T @ a).ravel() + ridge * w.ravel()
        hessian = np.einsum("mk,kl,mi,mj->kilj", p, np.eye(k), a, a) - np.einsum("mk,ml,mi,mj->kilj", p, p, a, a)
        hessian = hessian.reshape(k * (d + 1), -1) + np.diag(ridge) + np.outer(shift, shift)
        step = np.linalg.solve(hessian, gradient)
        w = w - step.reshape(w.shape)
        if np.abs(step).max() < 1e-12:
            break
    return w


def probabilities(eta: np.ndarray) -> np.ndarray:
    e = np.exp(eta - eta.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
