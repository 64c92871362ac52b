"""SuperMinHash signatures of many sets at once, in numpy.

Every element of a set has its own random permutation of the signature's
places and a random fraction for each rank; a place holds the smallest rank
plus fraction that any element brings to it.  Elements of all sets advance
rank by rank together, and a set stops as soon as each of its places holds a
value below the next rank, for no later rank can lower one.
"""

from __future__ import annotations

import numpy as np

from .words import U, mix

_RANK = U(57)  # a value is rank << 57 | fraction


def signatures(elements: np.ndarray, first: np.ndarray, m: int = 128, at_once: int = 1 << 15) -> np.ndarray:
    """One row of m values for each set; elements are the 64-bit hashes of
    all sets, first the index of each set's first element (one more at the
    end).  An empty set's values are all the largest."""
    n = len(first) - 1
    out = np.full((n, m), ~U(0), dtype=U)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(first, first[a] + at_once, side="right")) - 1)
        for s in range(int(first[a]), int(first[b]), 4 * at_once) if b == a + 1 else [int(first[a])]:
            e = min(s + 4 * at_once, int(first[b])) if b == a + 1 else int(first[b])
            owner = np.searchsorted(first[a : b + 1], np.arange(s, e), side="right") - 1
            _merge(out[a:b], elements[s:e], owner)
        a = b
    return out


def _merge(sig: np.ndarray, elements: np.ndarray, owner: np.ndarray) -> None:
    m = sig.shape[1]
    flat = sig.reshape(-1)
    order: np.ndarray | None = None
    for rank in range(m):
        if not len(elements):
            return
        x = mix(elements + U((rank + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        pick = rank + (((x & U(0xFFFFFFFF)) * U(m - rank)) >> U(32)).astype(np.int64)
        if order is None:
            place = pick
        else:
            row = np.arange(len(elements))
            place = order[row, pick].astype(np.int64)
            order[row, pick] = order[row, rank]
        np.minimum.at(flat, owner * m + place, (U(rank) << _RANK) | (x >> U(64) - _RANK))
        live = (sig.max(axis=1) >> _RANK) > U(rank)
        keep = live[owner]
        if order is None:
            elements, owner, pick = elements[keep], owner[keep], pick[keep]
            order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
            order[np.arange(len(elements)), pick] = 0
        elif not keep.all():
            elements, owner, order = elements[keep], owner[keep], order[keep]


def bands(sig: np.ndarray, rows: int = 4) -> np.ndarray:
    """A 64-bit key of each run of `rows` signature places."""
    n, m = sig.shape
    parts = sig.reshape(n, m // rows, rows)
    key = np.broadcast_to(mix(np.arange(1, m // rows + 1, dtype=U)), (n, m // rows)).copy()
    for k in range(rows):
        key = mix(key * U(0x2545F4914F6CDD1D) + parts[:, :, k])
    return key.view(np.int64)
