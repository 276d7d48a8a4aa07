"""Sparse linear models trained with follow-the-regularised-leader (FTRL-Proximal)."""

import numpy as np


class Rows:
    """Sparse training rows: feature numbers and values of all rows, one after another."""

    def __init__(self, starts: np.ndarray, features: np.ndarray, values: np.ndarray):
        self.starts, self.features, self.values = starts.astype(np.int64), features.astype(np.int64), values.astype(np.float64)

    @classmethod
    def from_arrow(cls, features, values) -> "Rows":
        """From two Arrow list columns, without a Python object per entry."""
        features, values = features.combine_chunks(), values.combine_chunks()
        sizes = np.diff(features.offsets.to_numpy())
        return cls(np.concatenate([[0], np.cumsum(sizes)]), features.flatten().to_numpy(), values.flatten().to_numpy())

    def take(self, rows: np.ndarray) -> "Rows":
        _, features, values = self.pick(rows)
        sizes = self.starts[rows + 1] - self.starts[rows]
        return Rows(np.concatenate([[0], np.cumsum(sizes)]), features, values)

    def order(self, label: np.ndarray) -> np.ndarray:
        """An order of the rows that depends on their content alone."""
        row = np.repeat(np.arange(len(self)), np.diff(self.starts))
        sums = [np.bincount(row, x, len(self)) for x in (self.features, self.features * self.values)]
        return np.lexsort((*sums, np.diff(self.starts), label))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row in the pick, feature, value) of every entry of the rows."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        at = np.repeat(self.starts[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return np.repeat(np.arange(len(rows)), sizes), self.features[at], self.values[at]

    def logits(self, weights: np.ndarray, bias: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        rows = np.arange(len(self)) if rows is None else rows
        row, feature, value = self.pick(rows)
        return np.stack([np.bincount(row, value * weights[feature, k], len(rows)) for k in range(len(bias))], 1) + bias


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def ftrl(
    rows: Rows, targets: np.ndarray, dim: int, l1: float, l2: float,
    alpha: float = 0.5, beta: float = 1.0, epochs: int = 5, batch: int = 64, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression with elastic-net penalties: (dim, K) weights and K biases.

    ``targets`` are class probabilities, one row each.  Per-coordinate learning rates;
    a weight is exactly 0 while its accumulated gradient stays below ``l1``.  The biases
    are updated the same way without penalties.
    """
    classes = targets.shape[1]
    z, n = np.zeros((dim, classes)), np.zeros((dim, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)

    def solve(z, n, l1, l2):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // batch)):
            row, feature, value = rows.pick(part)
            used, place = np.unique(feature, return_inverse=True)
            w, b = solve(z[used], n[used], l1, l2), solve(zb, nb, 0.0, 0.0)
            logits = np.stack([np.bincount(row, value * w[place, k], len(part)) for k in range(classes)], 1) + b
            miss = softmax(logits) - targets[part]
            g = np.stack([np.bincount(place, value * miss[row, k], len(used)) for k in range(classes)], 1)
            z[used] += g - (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / alpha * w
            n[used] += g * g
            gb = miss.sum(0)
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / alpha * b
            nb += gb * gb
    return solve(z, n, l1, l2), solve(zb, nb, 0.0, 0.0)


def temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The divisor of the logits with the least cross-entropy on rows not trained on."""
    if not len(logits):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-(targets * np.log(softmax(logits / t) + 1e-12)).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])
