"""Small boosted trees, grown with numpy on a bounded set and compiled to column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Split:
    feature: int
    above: float
    low: "Split | float"
    high: "Split | float"


def _leaf(g: np.ndarray, h: np.ndarray, rate: float) -> float:
    return float(rate * g.sum() / (h.sum() + 1.0))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> Split | float:
    best, gain = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    if depth and len(g) >= 10:
        for f in range(x.shape[1]):
            for t in np.unique(x[:, f])[:-1][:64]:
                up = x[:, f] > t
                now = g[up].sum() ** 2 / (h[up].sum() + 1.0) + g[~up].sum() ** 2 / (h[~up].sum() + 1.0) - whole
                if now > gain:
                    best, gain = (f, float(t), up), now
    if best is None:
        return _leaf(g, h, rate)
    f, t, up = best
    return Split(f, t, _grow(x[~up], g[~up], h[~up], depth - 1, rate), _grow(x[up], g[up], h[up], depth - 1, rate))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 16, depth: int = 3, rate: float = 0.4) -> list[Split | float]:
    """Trees whose sum is the log odds."""
    margin, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, y - p, p * (1 - p), depth, rate)
        trees.append(tree)
        margin += np.array([walk(tree, row) for row in x])
    return trees


def walk(tree: Split | float, row: Sequence[float]) -> float:
    while isinstance(tree, Split):
        tree = tree.high if row[tree.feature] > tree.above else tree.low
    return tree


def margin(trees: list[Split | float], row: Sequence[float]) -> float:
    return sum(walk(t, row) for t in trees)


def expression(trees: list[Split | float], features: Sequence[Column]) -> Column:
    def of(tree: Split | float) -> Column:
        if not isinstance(tree, Split):
            return F.lit(float(tree))
        return F.when(features[tree.feature] > tree.above, of(tree.high)).otherwise(of(tree.low))

    out = F.lit(0.0)
    for t in trees:
        out = out + of(t)
    return out
