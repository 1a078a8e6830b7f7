"""A small dense network in numpy: the per-minibatch arithmetic that runs inside Spark tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SEED = 2018  # fixed value: initializer seed

# Hidden layers of the tabular models.
HIDDEN = {"sanity": (10, 10), "confA": (1000, 500), "logistic": ()}


def layer_sizes(model: str, inputs: int, classes: int) -> list[int]:
    return [inputs, *HIDDEN[model], classes]


def parameter_count(layers: Sequence[int]) -> int:
    return sum(a * b + b for a, b in zip(layers[:-1], layers[1:]))


def initial_weights(layers: Sequence[int], seed: int = SEED) -> np.ndarray:
    """Uniform Glorot matrices and zero offsets as one float32 vector; a net without hidden layers starts at zero."""
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(layers[:-1], layers[1:]):
        limit = np.sqrt(6.0 / (a + b)) if len(layers) > 2 else 0.0
        parts += [rng.uniform(-limit, limit, size=a * b), np.zeros(b)]
    return np.concatenate(parts).astype(np.float32)


def _views(w: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(layers[:-1], layers[1:]):
        out.append((w[at:at + a * b].reshape(a, b), w[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def scores(w: np.ndarray, layers: Sequence[int], x: np.ndarray) -> np.ndarray:
    """Class probabilities."""
    h = x
    views = _views(w, layers)
    for i, (m, b) in enumerate(views):
        h = h @ m + b
        if i < len(views) - 1:
            h = np.maximum(h, 0)
    h = h - h.max(axis=1, keepdims=True)
    e = np.exp(h)
    return e / e.sum(axis=1, keepdims=True)


def gradient(w: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum over the rows of the cross-entropy gradient, y one-hot. The penalty is left to the update."""
    views, acts = _views(w, layers), [x]
    for m, b in views[:-1]:
        acts.append(np.maximum(acts[-1] @ m + b, 0))
    delta = scores(w, layers, x) - y
    out: list[np.ndarray] = []
    for i in range(len(views) - 1, -1, -1):
        out = [(acts[i].T @ delta).ravel(), delta.sum(axis=0), *out]
        if i:
            delta = (delta @ views[i][0].T) * (acts[i] > 0)
    return np.concatenate(out)


class Optimizer:
    """Adam (the default) or plain gradient descent with an L2 penalty on all parameters."""

    def __init__(self, size: int, rate: float, penalty: float, kind: str = "adam"):
        self.rate, self.penalty, self.kind, self.t = rate, penalty, kind, 0
        if kind == "adam":
            self.m, self.v = np.zeros(size), np.zeros(size)

    def step(self, w: np.ndarray, mean_gradient: np.ndarray) -> np.ndarray:
        g = mean_gradient + 2 * self.penalty * w
        if self.kind == "sgd":
            return w - self.rate * g
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        m, v = self.m / (1 - 0.9 ** self.t), self.v / (1 - 0.999 ** self.t)
        return w - self.rate * m / (np.sqrt(v) + 1e-7)


class Fit:
    """One model going through buffers in order."""

    def __init__(self, w: Sequence[float], layers: Sequence[int], rate: float, penalty: float, batch: int,
                 kind: str = "adam"):
        self.w = np.asarray(w, dtype=np.float64)
        self.layers, self.batch, self.n = list(layers), batch, 0
        self.optimizer = Optimizer(len(self.w), rate, penalty, kind)

    def see(self, x: np.ndarray, y: np.ndarray) -> None:
        for a in range(0, len(x), self.batch):
            xb, yb = x[a:a + self.batch], y[a:a + self.batch]
            self.w = self.optimizer.step(self.w, gradient(self.w, self.layers, xb, yb) / len(xb))
        self.n += len(x)


def evaluate_rows(w: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray, k: int) -> tuple[float, float]:
    """Summed cross-entropy and the number of rows whose class is among the ``k`` best."""
    p = scores(w, layers, x)
    own = (p * y).sum(axis=1)
    truth = y.argmax(axis=1)
    place = np.arange(p.shape[1])
    better = (p > own[:, None]) | ((p == own[:, None]) & (place[None, :] < truth[:, None]))
    hits = (better.sum(axis=1) < k) & (y.sum(axis=1) > 0)
    return float(-np.log(np.maximum(own, 1e-12)).sum()), float(hits.sum())
