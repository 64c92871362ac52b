"""One-dimensional cutting stock by column generation, on a length histogram.

The driver only sees counts by length class, whose number is fixed, so the
work does not grow with the rows.
"""

from __future__ import annotations

import numpy as np


def price(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable pattern of
    items that fits, and how often it holds each item."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = int(np.searchsorted(size, c, side="right"))
        best[c], choice[c] = best[c - 1], -1
        if fits:
            gain = best[c - size[:fits]] + value[:fits]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], choice[c] = gain[k], k
    pattern, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= size[choice[c]]
    return float(best[capacity]), pattern


def linear_program(size: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, most: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, fractional, so that all
    demand is met with nearly the fewest patterns: revised simplex whose
    entering column comes from `price`.  It ends within `gap` of the best
    value (Farley's bound) or after `most` pivots; any end is feasible."""
    n = len(size)
    patterns = np.diag(capacity // size).astype(float)
    inverse = np.diag(1.0 / np.diag(patterns))
    for _ in range(most):
        use = inverse @ demand
        dual = inverse.sum(axis=0)
        value, column = price(dual, size, capacity)
        if value <= 1 + gap:
            break
        move = inverse @ column
        ratio = np.full(n, np.inf)
        np.divide(use, move, out=ratio, where=move > 1e-10)
        leave = int(ratio.argmin())
        patterns[:, leave] = column
        row = inverse[leave] / move[leave]
        inverse -= np.outer(move, row)
        inverse[leave] = row
    return patterns.astype(np.int64), np.maximum(inverse @ demand, 0)


def plan(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns that hold each item exactly as often as demanded: the
    linear program's, rounded down, then first-fit decreasing for the rest,
    which has fewer items than one use of each pattern."""
    size, left = np.asarray(size, np.int64), np.asarray(demand, np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    if not len(size):
        return out
    patterns, use = linear_program(size, left.astype(float), capacity)
    for k in np.argsort(-use, kind="stable"):
        column = patterns[:, k]
        held = column > 0
        times = min(int(use[k] + 1e-9), int((left[held] // column[held]).min()))
        if times:
            out.append((column.copy(), times))
            left -= times * column
    while left.any():
        column, room = np.zeros(len(size), np.int64), capacity
        for c in np.flatnonzero(left)[::-1]:
            take = min(int(left[c]), room // int(size[c]))
            column[c], room = take, room - take * int(size[c])
        held = column > 0
        times = int((left[held] // column[held]).min())
        out.append((column, times))
        left -= times * column
    return out
