"""Small gradient-boosted trees for bounded training samples, fitted on the driver and compiled to Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    """A leaf where feature is -1; otherwise rows with x[feature] <= cut go left."""

    value: float
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


def _cuts(x: np.ndarray, most: int) -> np.ndarray:
    levels = np.unique(x)
    if len(levels) > most + 1:
        levels = np.unique(np.quantile(x, np.linspace(0, 1, most + 2)[1:-1], method="nearest"))
        return levels
    return (levels[:-1] + levels[1:]) / 2


def _grow(codes, cuts, grad, hess, rows, depth, reg, least) -> Node:
    g, h = grad[rows].sum(), hess[rows].sum()
    node = Node(float(-g / (h + reg)))
    if depth == 0 or len(rows) < 2 * least:
        return node
    best, base = 1e-9, g * g / (h + reg)
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        code = codes[rows, f]
        n = np.bincount(code, minlength=len(c) + 1).cumsum()[:-1]
        gl = np.bincount(code, grad[rows], len(c) + 1).cumsum()[:-1]
        hl = np.bincount(code, hess[rows], len(c) + 1).cumsum()[:-1]
        gain = gl**2 / (hl + reg) + (g - gl) ** 2 / (h - hl + reg) - base
        gain[(n < least) | (len(rows) - n < least)] = -1
        k = int(gain.argmax())
        if gain[k] > best:
            best, node.feature, node.cut, at = float(gain[k]), f, float(c[k]), k
    if node.feature >= 0:
        low = codes[rows, node.feature] <= at
        node.left = _grow(codes, cuts, grad, hess, rows[low], depth - 1, reg, least)
        node.right = _grow(codes, cuts, grad, hess, rows[~low], depth - 1, reg, least)
    return node


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def predict(tree: Node, x: np.ndarray) -> np.ndarray:
    if tree.feature < 0:
        return np.full(len(x), tree.value)
    low = x[:, tree.feature] <= tree.cut
    out = np.empty(len(x))
    out[low], out[~low] = predict(tree.left, x[low]), predict(tree.right, x[~low])
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, reg: float = 1.0, least: int = 20, bins: int = 32, row_share: float = 1.0, seed: int = 1) -> tuple[float, list[Node]]:
    """(start log-odds, trees) for binary y by Newton boosting on quantile bins; leaf values already hold the rate."""
    rng = np.random.default_rng(seed)
    cuts = [_cuts(x[:, f], bins) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    z, out = np.full(len(y), start), []
    for _ in range(trees):
        p = sigmoid(z)
        rows = np.flatnonzero(rng.random(len(y)) < row_share) if row_share < 1 else np.arange(len(y))
        tree = _grow(codes, cuts, p - y, np.maximum(p * (1 - p), 1e-6), rows, depth, reg, least)
        _scale(tree, rate)
        z = z + predict(tree, x)
        out.append(tree)
    return start, out


def _scale(tree: Node, rate: float) -> None:
    tree.value *= rate
    if tree.feature >= 0:
        _scale(tree.left, rate)
        _scale(tree.right, rate)


def column(tree: Node, features: list[Column]) -> Column:
    """The tree's value as nested CASE expressions."""
    if tree.feature < 0:
        return F.lit(tree.value)
    return F.when(features[tree.feature] <= F.lit(tree.cut), column(tree.left, features)).otherwise(column(tree.right, features))


Rule = tuple[tuple[int, bool, float], ...]


def paths(tree: Node, so_far: Rule = ()) -> list[Rule]:
    """Every path from the root to an inner or leaf node as a conjunction of (feature, is_at_most, cut)."""
    out = [so_far] if so_far else []
    if tree.feature >= 0:
        out += paths(tree.left, (*so_far, (tree.feature, True, tree.cut)))
        out += paths(tree.right, (*so_far, (tree.feature, False, tree.cut)))
    return out
