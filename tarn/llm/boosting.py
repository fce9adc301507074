"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete trees of one depth: feature and threshold per inner node, value per leaf."""

    start: float
    features: np.ndarray  # trees x inner nodes
    thresholds: np.ndarray
    values: np.ndarray  # trees x leaves
    slope: float = 1.0  # calibration of the margin
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for f, t, v in zip(self.features, self.thresholds, self.values, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: float = 2.0, l2: float = 1.0) -> Boosted:
    """Second-order boosting of the logistic loss with exact splits between observed values."""
    n, width = x.shape
    cuts = []
    for j in range(width):
        v = np.unique(x[:, j])
        mid = (v[1:] + v[:-1]) / 2
        cuts.append(mid if len(mid) <= 32 else np.unique(np.quantile(mid, np.linspace(0, 1, 32))))
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    margin = np.full(n, np.log(share / (1 - share)))
    start = float(margin[0]) if n else 0.0
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        f, t = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for k in range(inner):
            mine = node == k
            if mine.any():
                gs, hs = g[mine].sum(), h[mine].sum()
                best = 1e-6
                for j in range(width):
                    if not len(cuts[j]):
                        continue
                    b = bins[mine, j]
                    gl = np.cumsum(np.bincount(b, weights=g[mine], minlength=len(cuts[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, weights=h[mine], minlength=len(cuts[j]) + 1))[:-1]
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(hl < least) | (hs - hl < least)] = 0
                    at = int(np.argmax(gain))
                    if gain[at] > best:
                        best, f[k], t[k] = gain[at], j, cuts[j][at]
            node[mine] = 2 * k + 1 + (x[mine, f[k]] > t[k])
        v = np.zeros(leaves)
        for k in range(leaves):
            mine = node == inner + k
            v[k] = -rate * g[mine].sum() / (h[mine].sum() + l2)
        margin += v[node - inner]
        features.append(f)
        thresholds.append(t)
        values.append(v)
    return Boosted(start, np.array(features), np.array(thresholds), np.array(values))


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, rounds: int = 50) -> None:
    """Platt scaling on rows that were not used for fitting, by Newton steps."""
    m = model.margin(x)
    # targets drawn in a little, as Platt proposes
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * m + b)))
        w = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((p - target) * m).sum(), (p - target).sum()
        haa, hab, hbb = (w * m * m).sum() + 1e-6, (w * m).sum(), w.sum() + 1e-6
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    model.slope, model.shift = float(a), float(b)
