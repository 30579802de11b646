"""Follow-the-regularised-leader with elastic-net penalties, for sparse rows and any number of outputs."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights (width x outputs) and a bias; ``l1`` keeps weights of uninformative features at exactly 0."""

    def __init__(self, width: int, outputs: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n, self.w = (np.zeros((width, outputs), np.float32) for _ in range(3))
        self.bias, self.bias_n = np.zeros(outputs), np.full(outputs, 1.0)

    def margins(self, index, value, first) -> np.ndarray:
        """(rows x outputs); a row without features has the bias."""
        rows = np.zeros((len(first) - 1, self.w.shape[1]))
        full = np.flatnonzero(np.diff(first))
        if len(full):
            rows[full] = np.add.reduceat(self.w[index] * value[:, None], first[:-1][full], axis=0)
        return rows + self.bias

    def update(self, index, value, first, slope, l1: float | None = None) -> None:
        """One step for a batch, given the slope of the loss for each row and output (already averaged)."""
        l1 = self.l1 if l1 is None else l1
        each = np.repeat(slope, np.diff(first), axis=0) * value[:, None]
        used, inverse = np.unique(index, return_inverse=True)
        g = np.stack([np.bincount(inverse, weights=each[:, k], minlength=len(used)) for k in range(slope.shape[1])], 1).astype(np.float32)
        n = self.n[used] + g * g
        sigma = (np.sqrt(n) - np.sqrt(self.n[used])) / self.alpha
        z = self.z[used] + g - sigma * self.w[used]
        self.n[used], self.z[used] = n, z
        self.w[used] = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))
        s = slope.sum(0)
        self.bias_n += s * s
        self.bias -= self.alpha * s / np.sqrt(self.bias_n)


def rows_of(index, value, first, docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen sparse rows, in the order of ``docs``."""
    counts = first[docs + 1] - first[docs]
    begin = np.r_[0, np.cumsum(counts)]
    take = np.repeat(first[docs] - begin[:-1], counts) + np.arange(begin[-1])
    return index[take], value[take], begin


def join_rows(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of several batches as one."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(1, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.r_[0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))]
