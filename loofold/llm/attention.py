"""A small causal self-attention model in numpy: one layer, one head, trained by Adam.

Output is a softmax over classes of subword ids: frequent ids are classes of their own, all
others share one class and are told apart by their frequency in the whole training corpus.
Attention adds to the log frequency of a class behind the id before it, also counted over the
whole corpus, so the weights only learn what longer context tells.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np

from loofold.llm.words import spread, starts


#: Tokens whose logits are worked on at once, and windows whose tokens are sorted at once in scoring.
LOGITS = 768
SORTED = 1 << 12


@dataclass(frozen=True)
class Shape:
    """Sizes of the model and of its fit; ``window`` tokens see each other, ``stride`` are scored."""

    window: int = 32
    stride: int = 24
    width: int = 24
    hidden: int = 48
    classes: int = 384
    inputs: int = 1536
    steps: int = 1000
    batch: int = 128
    rate: float = 6e-3
    pass_rate: float = 6e-4  # of the pass over all training texts
    seed: int = 3


@dataclass
class Model:
    shape: Shape
    input_of: np.ndarray  # row of the embedding by subword id
    class_of: np.ndarray  # class by subword id; the last class is shared
    within: np.ndarray  # log probability of an id within its class
    prior: np.ndarray  # log frequency of each class behind each input row
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def prepared(counts: np.ndarray, end: int, shape: Shape) -> Model:
    """A model that knows the corpus frequencies of subword ids, its weights still random."""
    size = len(counts)
    counts = counts.astype(np.float64).copy()
    order = np.argsort(-counts, kind="stable")
    order = np.concatenate(([end], order[order != end]))
    own = shape.classes - 1
    class_of = np.full(size, own, np.int64)
    class_of[order[:own]] = np.arange(own)
    within = np.zeros(size)
    rest = class_of == own
    within[rest] = np.log((counts[rest] + 0.5) / (counts[rest] + 0.5).sum())
    spare = shape.inputs // 4
    input_of = shape.inputs - spare + np.arange(size) % spare
    top = order[: shape.inputs - spare]
    input_of[top] = np.arange(len(top))
    totals = np.bincount(class_of, counts + 0.5, minlength=shape.classes)
    rng, d, h = np.random.default_rng(shape.seed), shape.width, shape.hidden
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    weights = {
        "embed": (rng.standard_normal((shape.inputs, d)) * 0.3).astype(np.float32),
        "place": (rng.standard_normal((shape.window, d)) * 0.1).astype(np.float32),
        "query": draw(d, d), "key": draw(d, d), "value": draw(d, d), "out": draw(d, d) * np.float32(0.5),
        "up": draw(d, h), "bias": np.zeros(h, np.float32), "down": draw(h, d) * np.float32(0.5),
        "top": draw(d, shape.classes) * np.float32(0.3),
    }
    prior = np.log(totals / totals.sum()).astype(np.float32)
    return Model(shape, input_of, class_of, within, np.tile(prior, (shape.inputs, 1)), weights)


def pair_counts(model: Model, ids: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """How often each class stands behind each input row, flat; sequences with their ends."""
    before = previous(ids, lengths, end)
    cells = model.input_of[before] * model.shape.classes + model.class_of[ids]
    return np.bincount(cells, minlength=model.shape.inputs * model.shape.classes)


def with_pairs(model: Model, counts: np.ndarray, weight: float = 8.0) -> Model:
    """The model with log frequencies of classes behind each input, drawn to those of all."""
    counts = counts.reshape(model.shape.inputs, model.shape.classes).astype(np.float64)
    overall = np.exp(model.prior[0].astype(np.float64))
    model.prior = np.log((counts + weight * overall) / (counts.sum(axis=1, keepdims=True) + weight)).astype(np.float32)
    return model


def previous(ids: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The id before each; the end before a sequence begins."""
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[starts(lengths)[:-1]] = end
    return before


def windows(lengths: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Token places of overlapping windows over sequences, -1 before a sequence begins or after it ends.

    Windows step by ``stride`` and their last ``stride`` places are scored, so each token is
    scored once and sees at least window - stride tokens before it. Also the sequence of each.
    """
    n = -(-lengths // shape.stride)
    owner = np.repeat(np.arange(len(lengths)), n)
    step = spread(np.zeros(len(lengths), np.int64), n)
    place = step[:, None] * shape.stride + np.arange(shape.stride - shape.window, shape.stride)
    inside = (place >= 0) & (place < lengths[owner][:, None])
    return np.where(inside, place + starts(lengths)[:-1][owner][:, None], -1), owner


def _mask(shape: Shape) -> np.ndarray:
    """0 where a scored place may look, a large negative number ahead of it."""
    scored = np.arange(shape.window - shape.stride, shape.window)
    return np.where(np.arange(shape.window) <= scored[:, None], 0, -1e4).astype(np.float32)


def hidden(w: dict[str, np.ndarray], inputs: np.ndarray, shape: Shape, mask: np.ndarray):
    """Last hidden state of the scored places (windows * stride, width), and what the gradient needs.

    Queries and keys meet, and values leave, by one matrix each, so neither keys nor values of
    single places are worked out.
    """
    size, d = (len(inputs), shape.stride), shape.width
    unknown = inputs < 0
    x = w["embed"].take(inputs, axis=0, mode="clip")
    x += w["place"]
    turned = np.ascontiguousarray(x.transpose(0, 2, 1))
    xs = x[:, shape.window - shape.stride :].reshape(-1, d)
    q = xs @ (w["query"] @ w["key"].T * mask.dtype.type(1 / np.sqrt(d)))
    score = np.matmul(q.reshape(*size, d), turned)
    score += mask
    if unknown.any():
        score += np.where(unknown, mask.dtype.type(-1e4), mask.dtype.type(0))[:, None, :]
    np.minimum(score, 60, out=score)  # each place sees itself, so no sum is 0
    np.exp(score, out=score)
    score /= (score.reshape(-1, shape.window) @ np.ones(shape.window, score.dtype)).reshape(*size, 1)
    seen = np.matmul(score, x).reshape(-1, d)
    h = xs + seen @ (w["value"] @ w["out"])
    f = h @ w["up"]
    f += w["bias"]
    np.maximum(f, 0, out=f)
    return h + f @ w["down"], (x, turned, xs, q, score, seen, h, f)


def gradient(w: dict[str, np.ndarray], prior: np.ndarray, inputs: np.ndarray, targets: np.ndarray, shape: Shape, mask: np.ndarray):
    """Mean loss of the targets (-1 for none) and its gradient."""
    g, (x, turned, xs, q, a, seen, h, f) = hidden(w, inputs, shape, mask)
    past, size, d = shape.window - shape.stride, (len(inputs), shape.stride), {}
    loss, dg, d["top"] = output_gradient(w["top"], prior, g, inputs[:, past:].ravel(), targets.ravel())
    d["down"] = f.T @ dg
    df = dg @ w["down"].T
    df *= f > 0
    d["up"], d["bias"] = h.T @ df, np.ones(len(df), df.dtype) @ df
    dh = df @ w["up"].T
    dh += dg
    dvalue = seen.T @ dh  # of value @ out
    d["value"], d["out"] = dvalue @ w["out"].T, w["value"].T @ dvalue
    dseen = dh @ (w["value"] @ w["out"]).T
    split = lambda m: m.reshape(*size, shape.width)
    ds = np.matmul(split(dseen), turned)
    ds -= np.einsum("ij,ij->i", dseen, seen).reshape(*size, 1)
    ds *= a
    dq = np.matmul(ds, x).reshape(-1, shape.width)
    unit = mask.dtype.type(1 / np.sqrt(shape.width))
    dquery = xs.T @ dq * unit  # of query @ key.T
    d["query"], d["key"] = dquery @ w["key"], dquery.T @ w["query"]
    dx = np.matmul(ds.transpose(0, 2, 1), split(q))
    dx += np.matmul(a.transpose(0, 2, 1), split(dseen))
    dh += dq @ (w["key"] @ w["query"].T * unit)
    dx[:, past:] += split(dh)
    d["place"] = (np.ones(len(dx), dx.dtype) @ dx.reshape(len(dx), -1)).reshape(w["place"].shape)
    dx[inputs < 0] = 0
    d["embed"] = row_sums(dx.reshape(-1, shape.width), inputs.ravel(), shape.inputs)
    return loss, d


def output_gradient(top: np.ndarray, prior: np.ndarray, g: np.ndarray, rows: np.ndarray, targets: np.ndarray):
    """Mean loss of the targets, its gradient by the hidden states and by the output matrix.

    Logits are worked on some rows at a time, in place: they become what exp makes of them, then
    errors that the hidden states are scaled by, not they.
    """
    use = targets >= 0
    n, goals = max(1, int(use.sum())), np.maximum(targets, 0)
    far = np.sqrt((g * g).sum(axis=1).max(initial=0) * (top * top).sum(axis=0).max()) > 60  # else exp stays finite, its sum above 0
    back, ones = np.ascontiguousarray(top.T), np.ones(top.shape[1], g.dtype)
    dg, dtop, loss = np.empty_like(g), np.zeros_like(top), 0.0
    logits, before = (np.empty((min(len(g), LOGITS), top.shape[1]), t) for t in (g.dtype, prior.dtype))
    for i in range(0, len(g), LOGITS):
        here = slice(i, i + LOGITS)
        part = g[here]
        e, at = logits[: len(part)], (np.arange(len(part)), goals[here])
        np.matmul(part, top, out=e)
        e += prior.take(rows[here], axis=0, mode="clip", out=before[: len(part)])
        if far:
            e -= e.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        total = e @ ones
        loss -= float(np.log(e[at] / total + 1e-30)[use[here]].sum())
        e[at] -= total
        scale = (use[here] / (total * n)).astype(g.dtype)[:, None]
        dg[here] = e @ back
        dg[here] *= scale
        dtop += (part * scale).T @ e
    return loss / n, dg, dtop


def row_sums(values: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of values by row; by flat cells, which numpy adds up far faster than whole rows."""
    width = values.shape[1]
    cells = np.arange(size * width).reshape(size, width).take(rows, axis=0, mode="clip")
    total = np.zeros(size * width, values.dtype)
    np.add.at(total, cells.ravel(), values.ravel())
    return total.reshape(size, width)


def fitted(model: Model, sequences: list[np.ndarray], end: int) -> Model:
    """Trains the weights on sequences of subword ids, each without its end."""
    shape, w = model.shape, model.weights
    rng, mask = np.random.default_rng(shape.seed), _mask(shape)
    ids = np.concatenate([np.append(s, end) for s in sequences]) if sequences else np.zeros(0, np.int64)
    lengths = np.array([len(s) + 1 for s in sequences], np.int64)
    if not len(ids):
        return model
    place, _ = windows(lengths, shape)
    inputs, targets = network_inputs(model, ids, lengths, place, end), model.class_of[ids]
    scored = place[:, shape.window - shape.stride :]
    goals = np.where(scored >= 0, targets[np.maximum(scored, 0)], -1)
    adam = Adam(w)
    for step in range(1, shape.steps + 1):
        pick = rng.integers(len(place), size=shape.batch)
        _, d = gradient(w, model.prior, inputs[pick], goals[pick], shape, mask)
        adam.step(w, d, shape.rate * min(1.0, 10 * step / shape.steps, 0.05 + 1.5 * (1 - step / shape.steps)))
    return model


class Adam:
    def __init__(self, w: dict[str, np.ndarray]):
        self.first, self.second = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
        self.steps = 0

    def step(self, w: dict[str, np.ndarray], d: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        for k, x in w.items():
            self.first[k] += np.float32(0.1) * (d[k] - self.first[k])
            self.second[k] += np.float32(0.01) * (d[k] ** 2 - self.second[k])
            one, two = self.first[k] / (1 - 0.9**self.steps), self.second[k] / (1 - 0.99**self.steps)
            x -= (rate * one / (np.sqrt(two) + 1e-8)).astype(np.float32)


def passed(model: Model, ids: np.ndarray, lengths: np.ndarray, end: int) -> dict[str, np.ndarray]:
    """What one pass over all windows of some sequences, which hold their ends, changes in the weights."""
    shape, mask = model.shape, _mask(model.shape)
    w = {k: x.copy() for k, x in model.weights.items()}
    place, _ = windows(lengths, shape)
    place = place[np.random.default_rng(shape.seed).permutation(len(place))]
    inputs, targets, adam = network_inputs(model, ids, lengths, place, end), model.class_of[ids], Adam(w)
    for i in range(0, len(place), shape.batch):
        scored = place[i : i + shape.batch, shape.window - shape.stride :]
        goals = np.where(scored >= 0, targets[np.maximum(scored, 0)], -1)
        _, d = gradient(w, model.prior, inputs[i : i + shape.batch], goals, shape, mask)
        adam.step(w, d, shape.pass_rate * min(1.0, (adam.steps + 1) / 10))
    return {k: w[k] - x for k, x in model.weights.items()}


def network_inputs(model: Model, ids: np.ndarray, lengths: np.ndarray, place: np.ndarray, end: int) -> np.ndarray:
    """Embedding rows at each place of the windows: the token before it, the end before the first."""
    rows = model.input_of[previous(ids, lengths, end)]
    return np.where(place >= 0, rows[np.maximum(place, 0)], -1)


def log_probabilities(model: Model, ids: np.ndarray, lengths: np.ndarray, end: int, at_once: int = 128) -> np.ndarray:
    """Natural log probability of each id of some sequences, which hold their ends."""
    place, _ = windows(lengths, model.shape)
    inputs = network_inputs(model, ids, lengths, place, end)
    classes, out = model.class_of[ids], model.within[ids]
    share, reach = np.exp(model.prior), np.sqrt((model.weights["top"] ** 2).sum(axis=0)).max()
    for i in range(0, len(place), SORTED):
        add_class_probabilities(model, share, reach, inputs[i : i + SORTED], place[i : i + SORTED], classes, out, at_once)
    return out


def add_class_probabilities(model, share, reach, inputs, place, classes, out, at_once) -> None:
    """Adds the log probabilities of classes at the scored places of some windows.

    Tokens are sorted by the id before them, so that the frequencies behind it weigh all they share at once.
    """
    shape, w, mask = model.shape, model.weights, _mask(model.shape)
    states = np.empty((len(inputs) * shape.stride, shape.width), w["top"].dtype)
    for i in range(0, len(inputs), at_once):
        states[i * shape.stride : (i + at_once) * shape.stride] = hidden(w, inputs[i : i + at_once], shape, mask)[0]
    at, rows = (m[:, shape.window - shape.stride :].ravel() for m in (place, inputs))
    use = np.flatnonzero(at >= 0)
    use = use[np.argsort(rows[use].astype(np.min_scalar_type(shape.inputs)), kind="stable")]
    at, rows = at[use], rows[use]
    goals = classes[at]
    own, total = model.prior[rows, goals], np.empty(len(at), share.dtype)
    cuts = np.union1d(np.flatnonzero(np.diff(rows, prepend=-1)), [*range(0, len(at), LOGITS), len(at)]).tolist()
    logits, begin = np.empty((min(len(at), LOGITS), shape.classes), states.dtype), 0
    for i, j in pairwise(cuts):
        if i % LOGITS == 0:  # a new block; logits stay in the processor's cache
            here, begin = slice(i, i + LOGITS), i
            g = states.take(use[here], axis=0)
            g *= np.minimum(1, 60 / (np.sqrt(np.einsum("ij,ij->i", g, g)) * reach + 1e-6))[:, None]  # exp stays finite
            lift = np.matmul(g, w["top"], out=logits[: len(g)])
            own[here] += lift[np.arange(len(lift)), goals[here]]
            np.exp(lift, out=lift)
        total[i:j] = lift[i - begin : j - begin] @ share[rows[i]]
    out[at] += own - np.log(total)
