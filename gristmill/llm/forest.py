"""Bagged decision trees: trained on a bounded sample, applied as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    value: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, rng: np.random.Generator, least: int) -> Node:
    total = w.sum()
    node = Node(float((w * y).sum() / total))
    if depth == 0 or len(y) < 2 * least or node.value in (0.0, 1.0):
        return node
    best, gini = None, 2 * node.value * (1 - node.value) * total - 1e-9
    for f in rng.choice(x.shape[1], max(1, int(np.ceil(x.shape[1] * 0.7))), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, yw, ww = x[order, f], (w * y)[order].cumsum(), w[order].cumsum()
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at >= least - 1) & (at < len(v) - least)]
        if not len(at):
            continue
        nl, pl = ww[at], yw[at]
        nr, pr = total - nl, yw[-1] - pl
        cost = 2 * (pl * (nl - pl) / nl + pr * (nr - pr) / nr)
        i = int(cost.argmin())
        if cost[i] < gini:
            gini, best = cost[i], (int(f), float((v[at[i]] + v[at[i] + 1]) / 2))
    if best is None:
        return node
    node.feature, node.cut = best
    low = x[:, node.feature] <= node.cut
    node.low = _grow(x[low], y[low], w[low], depth - 1, rng, least)
    node.high = _grow(x[~low], y[~low], w[~low], depth - 1, rng, least)
    return node


def train(x: np.ndarray, y: np.ndarray, n_trees: int = 20, depth: int = 7, seed: int = 5, least: int = 5) -> list[Node]:
    """Trees on bootstrap samples; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    w = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    trees = []
    for _ in range(n_trees):
        rows = rng.integers(0, len(y), len(y))
        trees.append(_grow(x[rows], y[rows], w[rows], depth, rng, least))
    return trees


def _sql(node: Node, names: list[str]) -> str:
    if node.low is None:
        return f"{node.value:.6f}D"
    return f"if(`{names[node.feature]}` <= {node.cut!r}D, {_sql(node.low, names)}, {_sql(node.high, names)})"


def vote(trees: list[Node], names: list[str]) -> Column:
    """Mean vote of the trees, evaluated in the JVM; 0 where no tree was trained."""
    if not trees:
        return F.lit(0.0)
    return sum((F.expr(_sql(t, names)) for t in trees), F.lit(0.0)) / float(len(trees))
