"""Exact one-to-one assignment of least total cost (JN14)."""

from __future__ import annotations

import numpy as np


def optimal_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, min(rows, columns) of them, by row.

    Shortest augmenting paths with potentials, O(n^2 m). Infinite costs are never chosen unless a
    row has nothing else, in which case the pair is left out. An empty matrix gives no pairs.
    """
    cost = np.asarray(cost, dtype=np.float64)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in optimal_assignment(cost.T))
    n, m = cost.shape
    finite = cost[np.isfinite(cost)]
    wall = (float(np.abs(finite).max()) if finite.size else 1.0) * (n + m + 1) + 1.0
    work = np.where(np.isfinite(cost), cost, wall)
    row_price, col_price = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.full(m + 1, -1)
    for i in range(n):
        owner[m], col = i, m
        slack, came = np.full(m, np.inf), np.full(m, m)
        used = np.zeros(m + 1, dtype=bool)
        while owner[col] >= 0:
            used[col] = True
            r = owner[col]
            reduced = work[r] - row_price[r] - col_price[:m]
            free = ~used[:m]
            better = free & (reduced < slack)
            slack[better], came[better] = reduced[better], col
            nxt = int(np.where(free, slack, np.inf).argmin())
            delta = slack[nxt]
            row_price[owner[used]] += delta
            col_price[used] -= delta
            slack[free] -= delta
            col = nxt
        while col != m:
            owner[col] = owner[came[col]]
            col = came[col]
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0 and np.isfinite(cost[owner[j], j]))
