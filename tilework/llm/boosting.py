"""Gradient boosted trees on a small labelled sample, turned into a SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A leaf (value) or a split: at most ``cut`` goes to ``low``."""

    value: float = 0.0
    feature: int = -1
    cut: int = 0
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.low.predict(x), self.high.predict(x))

    def sql(self, names: list[str]) -> str:
        if self.low is None:
            return f"{self.value:.6f}D"
        return f"if({names[self.feature]} <= {self.cut}, {self.low.sql(names)}, {self.high.sql(names)})"


def _grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int, rate: float, least: int) -> Tree:
    value = rate * gradient.sum() / (weight.sum() + 1.0)
    best = (1e-6, -1, 0)
    if depth:
        whole = gradient.sum() ** 2 / (weight.sum() + 1.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, g, w = x[order, f], np.cumsum(gradient[order]), np.cumsum(weight[order])
            at = np.flatnonzero(v[1:] != v[:-1])
            at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
            if len(at):
                gain = g[at] ** 2 / (w[at] + 1.0) + (g[-1] - g[at]) ** 2 / (w[-1] - w[at] + 1.0) - whole
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), f, int(v[at[k]])))
    if best[1] < 0:
        return Tree(value)
    side = x[:, best[1]] <= best[2]
    grow = lambda s: _grow(x[s], gradient[s], weight[s], depth - 1, rate, least)
    return Tree(value, best[1], best[2], grow(side), grow(~side))


@dataclass
class Boosted:
    """Log odds: a constant and trees."""

    start: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def sql(self, names: list[str]) -> str:
        return " + ".join([f"{self.start:.6f}D", *[t.sql(names) for t in self.trees]])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5) -> Boosted:
    """Logistic loss. x: whole numbers, a row per example; y: 0 or 1."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), [])
    odds = np.full(len(y), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        tree = _grow(x, y - p, p * (1 - p), depth, rate, least)
        model.trees.append(tree)
        odds += tree.predict(x)
    return model


def threshold(odds: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest log odds from which on so large a share of the examples is positive; infinite if there is none."""
    order = np.argsort(-odds, kind="stable")
    o, right = odds[order], np.cumsum(y[order])
    last = np.append(o[1:] != o[:-1], True)  # ties are taken together
    good = np.flatnonzero(last & (right >= precision * np.arange(1, len(o) + 1)))
    return float(o[good[-1]]) if len(good) else float("inf")
