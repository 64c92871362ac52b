"""Gradient boosted regression trees for small labelled sets, in numpy, and
the same trees as a Column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Leaf:
    value: float


@dataclass
class Split:
    """Left where feature < cut."""

    feature: int
    cut: float
    left: Leaf | Split
    right: Leaf | Split


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, smooth: float) -> Leaf | Split:
    best, choice = 1e-6, None
    total = grad.sum() ** 2 / (hess.sum() + smooth)
    if depth:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, g, h = x[order, f], grad[order].cumsum(), hess[order].cumsum()
            at = np.flatnonzero(v[1:] > v[:-1])
            if not len(at):
                continue
            gain = g[at] ** 2 / (h[at] + smooth) + (g[-1] - g[at]) ** 2 / (h[-1] - h[at] + smooth) - total
            k = int(gain.argmax())
            if gain[k] > best:
                best, choice = float(gain[k]), (f, float(v[at[k]] + v[at[k] + 1]) / 2)
    if choice is None:
        return Leaf(float(grad.sum() / (hess.sum() + smooth)))
    side = x[:, choice[0]] < choice[1]
    return Split(*choice, _grow(x[side], grad[side], hess[side], depth - 1, smooth), _grow(x[~side], grad[~side], hess[~side], depth - 1, smooth))


def _value(node: Leaf | Split, x: np.ndarray) -> np.ndarray:
    if isinstance(node, Leaf):
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] < node.cut, _value(node.left, x), _value(node.right, x))


def _column(node: Leaf | Split, feature: Callable[[int], Column]) -> Column:
    if isinstance(node, Leaf):
        return F.lit(node.value)
    return F.when(feature(node.feature) < F.lit(node.cut), _column(node.left, feature)).otherwise(_column(node.right, feature))


@dataclass
class Boosted:
    bias: float
    rate: float
    trees: list[Leaf | Split]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.bias + self.rate * sum((_value(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, feature: Callable[[int], Column]) -> Column:
        """The logit over feature columns; values are summed in tree order."""
        out = F.lit(self.bias)
        for t in self.trees:
            out = out + F.lit(self.rate) * _column(t, feature)
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 16, depth: int = 3, rate: float = 0.3, smooth: float = 1.0) -> Boosted:
    """Logistic loss, second-order leaves."""
    mean = np.clip(y.mean(), 0.01, 0.99)
    out = Boosted(float(np.log(mean / (1 - mean))), rate, [])
    logit = np.full(len(y), out.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        tree = _grow(x, y - p, p * (1 - p), depth, smooth)
        out.trees.append(tree)
        logit += rate * _value(tree, x)
    return out


def threshold(logit: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest cut above which at least `precision` of the rows are
    positive, halfway to the next row below; infinite if there is none."""
    order = np.argsort(-logit, kind="stable")
    x, share = logit[order], y[order].cumsum() / np.arange(1, len(y) + 1)
    good = np.flatnonzero((share >= precision) & np.append(x[1:] < x[:-1], True))
    if not len(good):
        return float("inf")
    k = int(good[-1])
    return float((x[k] + x[min(k + 1, len(x) - 1)]) / 2)
