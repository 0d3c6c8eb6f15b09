"""Sparse linear models: multinomial logistic regression by follow-the-regularised-leader, and temperature calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

Row = tuple[np.ndarray, np.ndarray]  # feature numbers, each once, and their values


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Ftrl:
    """FTRL-proximal over ``size`` features and ``classes`` classes with an elastic net; one class is a plain logistic model.

    Per coordinate steps of ``rate``; ``l1`` keeps weights at zero until their gradients
    add up to it, ``l2`` shrinks them. The intercept is a feature of its own without penalty.
    """

    size: int
    classes: int
    rate: float = 0.3
    l1: float = 0.3
    l2: float = 1e-3
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z = np.zeros((self.size + 1, self.classes), np.float64)
        self.n = np.zeros((self.size + 1, self.classes), np.float64)

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == self.size, 0.0, self.l1)[:, None]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1.0 + np.sqrt(self.n[at])) / self.rate + self.l2))

    def learn(self, row: Row, target: int) -> None:
        at, x = np.append(row[0], self.size), np.append(row[1], 1.0)
        w = self._weights(at)
        if self.classes == 1:
            p = np.array([1.0 / (1.0 + np.exp(-min(max(float(x @ w[:, 0]), -35.0), 35.0))) - target])
        else:
            p = softmax(x @ w)
            p[target] -= 1.0
        g = x[:, None] * p
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.rate * w
        self.n[at] = more

    def weights(self) -> np.ndarray:
        """(size + 1, classes); the last row is the intercept."""
        return self._weights(np.arange(self.size + 1)).astype(np.float32)


def train(rows: list[Row], targets: list[int], size: int, classes: int, epochs: int = 4, seed: int = 1, **how) -> np.ndarray:
    """Weights after ``epochs`` passes in an order that depends on ``seed`` alone."""
    model, draw = Ftrl(size, classes, **how), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)).tolist():
            model.learn(rows[i], targets[i])
    return model.weights()


def probability(weights: np.ndarray, row: Row) -> float:
    """What a plain logistic model says."""
    return 1.0 / (1.0 + float(np.exp(-np.clip(row[1] @ weights[row[0], 0] + weights[-1, 0], -35, 35))))


def scores(weights: np.ndarray, row: Row) -> np.ndarray:
    return row[1] @ weights[row[0]] + weights[-1]


def temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, between 1/20 and 20, by golden section."""
    if not len(targets):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(targets)), targets]
        return float(-np.mean(np.log(np.maximum(p, 1e-12))))

    a, b = -3.0, 3.0
    ratio = (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))
