"""Anchors: places chosen by content, so that equal strings of a given length
choose the same place in themselves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .words import _BASE, _BYTES, _INVERSE, U, _powers, mix

#: Bits of a place in a segment; a segment is at most this long.
_PLACE = 22


@dataclass
class Anchors:
    """Of each anchor: its text, the first string start that chose it, how
    many starts did, its distance from the first; hash of its own bytes (gram)
    and of all bytes its strings cover (span)."""

    text: np.ndarray
    start: np.ndarray
    many: np.ndarray
    offset: np.ndarray
    gram: np.ndarray
    span: np.ndarray


def _lowest(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive values."""
    n = len(v)
    pad = -n % w
    x = np.concatenate([v, np.full(pad, ~U(0), U)]).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).reshape(-1)
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - w + 1
    return np.minimum(right[:m], left[w - 1 : w - 1 + m])


def find_anchors(texts: list[bytes], length: int = 200, gram: int = 64) -> Anchors:
    """Anchors of all strings of `length` bytes in the texts: of the grams in
    a string the one with the smallest hash, the first of equals."""
    parts: list[tuple[np.ndarray, ...]] = []
    step = (1 << _PLACE) - length
    long = [(i, t) for i, t in enumerate(texts) if len(t) > step]
    short = [(i, t) for i, t in enumerate(texts) if length <= len(t) <= step]
    group: list[tuple[int, int, bytes]] = []
    for i, t in long:
        for s in range(0, len(t) - length + 1, step):
            parts.append(_segment([(i, s, t[s : s + step + length - 1])], length, gram))
    size = 0
    for i, t in short:
        if size + len(t) + 1 > step:
            parts.append(_segment(group, length, gram))
            group, size = [], 0
        group.append((i, 0, t))
        size += len(t) + 1
    if group:
        parts.append(_segment(group, length, gram))
    if not parts:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none, none, none)
    return Anchors(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _segment(group: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    buf = np.frombuffer(b"\0".join(t for _, _, t in group), np.uint8)
    n = len(buf)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTES[buf] * _powers(_BASE, n), out=total[1:])
    back = _powers(_INVERSE, n)
    g = mix((total[gram:] - total[:-gram]) * back[: n - gram + 1])
    mask = U((1 << _PLACE) - 1)
    chosen = (_lowest((g & ~mask) | np.arange(len(g), dtype=U), length - gram + 1) & mask).astype(np.int64)
    # only starts whose string lies in one text
    sizes = np.array([len(t) for _, _, t in group], np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    valid = np.zeros(n + 1, np.int8)
    valid[base] += 1
    np.add.at(valid, base + sizes - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[: len(chosen)]) > 0)
    head = np.flatnonzero(np.concatenate([[True], (chosen[at][1:] != chosen[at][:-1]) | (np.diff(at) != 1)]))
    first, many = at[head], np.diff(np.append(head, len(at)))
    place = chosen[first]
    end = first + many - 1 + length
    span = mix((total[end] - total[first]) * back[first] + (end - first).astype(U) * U(0x632BE59BD9B4E019) + (place - first).astype(U))
    owner = np.searchsorted(base, first, side="right") - 1
    text = np.array([i for i, _, _ in group], np.int64)[owner]
    shift = np.array([s for _, s, _ in group], np.int64)[owner]
    return text, first - base[owner] + shift, many, place - first, g[place].view(np.int64), span.view(np.int64)
