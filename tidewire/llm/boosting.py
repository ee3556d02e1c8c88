"""Gradient-boosted trees in numpy: logistic loss, second-order gains, exact splits over few distinct values."""

from __future__ import annotations

import numpy as np


class Trees:
    """``trees``: nested (feature, threshold, left, right), left for values up to the threshold; leaves are numbers."""

    def __init__(self, base: float, trees: list, names: list[str]):
        self.base, self.trees, self.names = base, trees, names

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            stack = [(tree, np.arange(len(x)))]
            while stack:
                node, at = stack.pop()
                if not isinstance(node, tuple):
                    out[at] += node
                    continue
                feature, threshold, left, right = node
                low = x[at, feature] <= threshold
                stack += [(left, at[low]), (right, at[~low])]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))

    def sql(self, column: str = "{}") -> str:
        """Log odds as a SQL expression; ``column`` gives a feature's expression from its name."""

        def case(node) -> str:
            if not isinstance(node, tuple):
                return f"{node:.9g}D"
            feature, threshold, left, right = node
            return f"CASE WHEN {column.format(self.names[feature])} <= {threshold:.9g}D THEN {case(left)} ELSE {case(right)} END"

        return " + ".join([f"{self.base:.9g}D", *(case(t) for t in self.trees)])


def fit(x: np.ndarray, y: np.ndarray, names: list[str], weight: np.ndarray | None = None, rounds: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 1.0, bins: int = 32) -> Trees:
    """Trees for labels ``y`` (0 or 1); with labels of one kind, or none, a constant."""
    weight = np.ones(len(y)) if weight is None else weight.astype(float)
    share = (weight @ y + 0.5) / (weight.sum() + 1) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or len(np.unique(y)) < 2:
        return Trees(base, [], names)
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(middle if len(middle) <= bins else np.unique(np.quantile(middle, np.linspace(0, 1, bins))))
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    score, trees = np.full(len(y), base), []

    def grow(at: np.ndarray, left: int, g: np.ndarray, h: np.ndarray):
        total_g, total_h = g[at].sum(), h[at].sum()
        best = (1e-6, None, None)
        if left and len(at) > 1:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                low_g = np.cumsum(np.bincount(binned[at, f], weights=g[at], minlength=len(c) + 1))[:-1]
                low_h = np.cumsum(np.bincount(binned[at, f], weights=h[at], minlength=len(c) + 1))[:-1]
                gain = low_g**2 / (low_h + penalty) + (total_g - low_g) ** 2 / (total_h - low_h + penalty) - total_g**2 / (total_h + penalty)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] is None:
            return float(-rate * total_g / (total_h + penalty))
        _, f, k = best
        low = binned[at, f] <= k
        return f, float(cuts[f][k]), grow(at[low], left - 1, g, h), grow(at[~low], left - 1, g, h)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p)
        tree = grow(np.arange(len(y)), depth, g, h)
        trees.append(tree)
        score = score + Trees(0.0, [tree], names).log_odds(x)
    return Trees(base, trees, names)
