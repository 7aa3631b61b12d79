"""A small decision tree: grown by Gini impurity in numpy, applied as plain tuples."""

from __future__ import annotations

import numpy as np


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1):
    """A nested (feature, cutoff, at most, above), or the share of ones at a leaf. Ties go to the first feature and the lowest cutoff."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = (share * (1 - share) * len(y), None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(values[1:] > values[:-1]) + 1
        at = at[(at >= least) & (at <= len(y) - least)]
        if not len(at):
            continue
        left, right = ones[at - 1] / at, (ones[-1] - ones[at - 1]) / (len(y) - at)
        impurity = left * (1 - left) * at + right * (1 - right) * (len(y) - at)
        i = int(np.argmin(impurity))
        if impurity[i] < best[0] - 1e-12:
            best = (float(impurity[i]), f, float(values[at[i] - 1] + values[at[i]]) / 2)
    if best[1] is None:
        return share
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def decide(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree
