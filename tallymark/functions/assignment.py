"""One-to-one assignment of two small sides by score."""

from __future__ import annotations

import numpy as np


def greedy(scores: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs by descending score, ties in row then column order, each side used once,
    none below ``least``."""
    order = np.argsort(-scores, axis=None, kind="stable")
    rows, cols, out = set(), set(), []
    for k in order.tolist():
        i, j = divmod(k, scores.shape[1])
        if scores[i, j] < least:
            break
        if i not in rows and j not in cols:
            rows.add(i)
            cols.add(j)
            out.append((i, j))
    return out


def optimal(cost: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of least total cost of all rows or all columns, whichever are fewer, by
    shortest augmenting paths with potentials."""
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((j, i) for i, j in optimal(cost.T))
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        gap, back, seen = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while owner[at]:
            seen[at] = True
            free = np.flatnonzero(~seen[1:]) + 1
            slack = cost[owner[at] - 1, free - 1] - u[owner[at]] - v[free]
            better = slack < gap[free]
            gap[free[better]], back[free[better]] = slack[better], at
            step = free[int(np.argmin(gap[free]))]
            delta = gap[step]
            u[owner[seen]] += delta
            v[seen] -= delta
            gap[~seen] -= delta
            at = step
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def align(cosines: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Optimal pairs of greatest similarity; pairs below ``least`` are not allowed."""
    allowed = cosines >= least
    pairs = optimal(np.where(allowed, 1 - cosines, 1e6))
    return [(i, j) for i, j in pairs if allowed[i, j]]
