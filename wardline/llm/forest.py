"""Spanning forests of the links that one task finds."""

from __future__ import annotations

import numpy as np


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component under the links a[i] - b[i]."""
    low = np.arange(n)
    while len(a):
        x, y = low[a], low[b]
        keep = x != y
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    return low
