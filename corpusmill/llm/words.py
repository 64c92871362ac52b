"""Words of many texts as ragged numpy arrays, with 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z:
#: digits, letters and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True
#: Word bytes of `[^\x20\x09-\x0D]+`.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.ones(size, dtype=U)
        done = 1
        while done < size:  # doubling: p[k:2k] = p[:k] * base^k
            take = min(done, size - done)
            out[done : done + take] = out[:take] * U(pow(base, done, 1 << 64))
            done += take
        if size > 1 << 23:
            return out
        _tables[base] = have = out
    return have[:n]


_BYTES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


@dataclass
class Words:
    """start, end: byte positions in the joined buffer; first: index of each
    document's first word (one more entry at the end); hash: of each word."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray | None
    base: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: list[bytes], is_word: np.ndarray, hashes: bool = True) -> Words:
    """Words of the texts, A-Z lower-cased for the hashes."""
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    inside = np.concatenate([[False], is_word[buf]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    first = np.searchsorted(start, base)
    h = None
    if hashes:
        n = len(buf)
        total = np.zeros(n + 1, dtype=U)
        np.cumsum(_BYTES[LOWER[buf]] * _powers(_BASE, n), out=total[1:])
        h = mix((total[end] - total[start]) * _powers(_INVERSE, n)[start] + (end - start).astype(U))
    return Words(start, end, first, h, base)


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n consecutive words of each document, repeats
    included, and their first indices by document.  A document of 1 to n-1
    words has one shingle, its whole sequence; one without words has none."""
    counts = w.counts()
    if w.hash is None:
        raise ValueError("words without hashes")
    many = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(first[-1], dtype=U)
    doc = np.repeat(np.arange(len(counts)), many)
    at = w.first[doc] + np.arange(first[-1]) - first[doc]
    long = counts[doc] >= n
    a = at[long]
    acc = np.zeros(len(a), dtype=U)
    for k in range(n):
        acc = mix(acc * U(0x2545F4914F6CDD1D) + w.hash[a + k])
    out[long] = acc
    for i in np.flatnonzero(~long):
        x = np.zeros(1, dtype=U)
        for h in w.hash[at[i] : at[i] + counts[doc[i]]]:
            x = mix(x * U(0x2545F4914F6CDD1D) + h)
        out[i] = mix(x + U(counts[doc[i]]))[0]
    return out, first
