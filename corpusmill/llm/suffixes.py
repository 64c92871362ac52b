"""Maximal repeats from a common-prefix interval tree over an enhanced suffix
array, in numpy, for strings that together fit in a worker."""

from __future__ import annotations

import numpy as np


def _ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    step = np.concatenate([[0], key[order][1:] != key[order][:-1]])
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(step)
    return out


def prefix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Rank of each place by the `length` bytes from it, by prefix doubling
    from 8 packed bytes; equal strings have equal ranks.  Bytes beyond the end
    count as 0; length is at least 8."""
    n = len(text)
    packed = np.zeros(n, np.uint64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in range(8):
        packed = (packed << np.uint64(8)) | padded[k : k + n]
    rank, have = _ranked(packed), 8
    while have < length:
        move = min(have, length - have)
        later = np.zeros(n, np.int64)
        later[: n - move] = rank[move:] + 1
        rank = _ranked(rank * (n + 1) + later)
        have += move
    return rank


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # the first difference lies in [low, high)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def maximal_repeats(strings: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Every maximal repeat of at least `least` bytes among the strings: its
    length and all its occurrences (string, place).

    The suffixes are sorted by their first `least` bytes; a run of equal ones
    is an interval of the common-prefix tree, whose part below is found by
    sorting the run by what follows and scanning the common prefixes of
    neighbours with a stack.  An interval whose occurrences all have the same
    byte before them is not maximal, and then nothing below it is either, so
    most runs are passed over at once; the start of a string counts as a byte
    of its own.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    base = np.cumsum(sizes + 1) - sizes - 1
    raw = b"\0".join(strings)
    text = np.frombuffer(raw, np.uint8)
    if len(text) < least:
        return []
    rank = prefix_ranks(text, least)
    owner = np.repeat(np.arange(len(strings)), np.append(sizes[:-1] + 1, sizes[-1]))
    place = np.arange(len(text)) - base[owner]
    valid = np.flatnonzero(place + least <= sizes[owner])
    order = valid[np.argsort(rank[valid], kind="stable")]
    if len(order) < 2:
        return []
    # the byte before, and for starts of strings numbers that differ
    before = np.where(place[order] > 0, text[np.maximum(order - 1, 0)].astype(np.int64), 256 + owner[order])
    head = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
    many = np.diff(np.append(head, len(order)))
    mixed = np.maximum.reduceat(before, head) != np.minimum.reduceat(before, head)
    out = []
    for h, n in zip(head[(many > 1) & mixed].tolist(), many[(many > 1) & mixed].tolist(), strict=True):
        at = order[h : h + n].tolist()
        left = before[h : h + n].tolist()
        tails = [raw[p + least : int(base[owner[p]] + sizes[owner[p]])] for p in at]
        by = sorted(range(n), key=tails.__getitem__)
        lcp = [least + _common(tails[a], tails[b]) for a, b in zip(by[:-1], by[1:], strict=True)]
        # stack of (common prefix, first index, the byte before or None if they differ)
        stack: list[list] = []
        for k in range(n):
            now, first, kind = (lcp[k - 1] if k else 0), k, left[by[k]]
            while stack and stack[-1][0] > now:
                depth, first, seen = stack.pop()
                if seen is None:
                    out.append((depth, [(int(owner[at[i]]), int(place[at[i]])) for i in by[first:k]]))
                if stack and stack[-1][0] >= now:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else None
                else:
                    stack.append([now, first, seen])
                    break
            nxt = lcp[k] if k < n - 1 else 0
            if nxt > (stack[-1][0] if stack else 0):
                stack.append([nxt, k, kind])
            elif stack:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == kind else None
        while stack:
            depth, first, seen = stack.pop()
            if depth >= least and seen is None:
                out.append((depth, [(int(owner[at[i]]), int(place[at[i]])) for i in by[first:n]]))
            if stack:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else None
    return out
