"""Terms of texts, and posting lists in compressed blocks of fixed size."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .words import ALNUM, LOWER, words

#: Postings of a block.
BLOCK = 64


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, pa.BinaryArray, np.ndarray]:
    """Of all texts together: each term's number, in the order of the texts;
    the different terms, A-Z lower-cased; the first index of each text (one
    more at the end).  Terms are told apart by their bytes."""
    w = words(texts, ALNUM, hashes=False)
    buf = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    offsets = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int64)
    data = buf[ALNUM[buf]]
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.binary()), w.first


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers, seven bits a byte, the last byte of each below
    128; and how many bytes each takes."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    left, at, k = values, end - size, 0
    more = np.arange(len(values))
    while len(more):
        low, left = (left & np.uint64(127)).astype(np.uint8), left >> np.uint64(7)
        last = size[more] == k + 1
        out[at[more] + k] = np.where(last, low, low | 128)
        more, left, k = more[~last], left[~last], k + 1
    return out, size


def from_bytes(data: bytes | np.ndarray) -> np.ndarray:
    """What `to_bytes` was given."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 128
    end = np.flatnonzero(last)
    start = np.append(0, end[:-1] + 1)
    shift = np.arange(len(raw)) - np.repeat(start, end - start + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * shift), start)


def _cut(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive parts."""
    offsets = np.append(0, ends).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def inverted(texts: list[bytes], block: int = BLOCK) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """How many terms each text has, and one posting list a term, as columns:
    term; df; lasts, the last text of each block (its distance from the block
    before); sizes, the bytes of each block; tops, how many pairs of each
    block can be its largest impact; pairs, these (tf, terms of the text);
    data, the blocks: for each posting the distance from the text before, and
    the term's frequency.

    A posting's impact grows with tf and shrinks with the text's length, by
    whatever statistics a search brings.  So the largest impact of a block is
    that of one of its pairs that no other one beats in both, and these are
    stored; the index does not change when statistics do.
    """
    number, term, first = terms_of(texts)
    n = np.diff(first)
    many = len(texts)
    key, tf = np.unique(number * max(many, 1) + np.repeat(np.arange(many), n), return_counts=True)
    own, doc = key // max(many, 1), key % max(many, 1)
    starts = np.searchsorted(own, np.arange(len(term)))
    df = np.diff(np.append(starts, len(own)))
    place = np.arange(len(own)) - starts[own]
    opens = place % block == 0
    b_first = np.flatnonzero(opens)
    b_term = own[b_first]
    b_end = np.append(b_first[1:], len(own))
    b_of = np.cumsum(opens) - 1

    gap = doc.copy()
    gap[1:] -= np.where(own[1:] == own[:-1], doc[:-1], 0)
    both = np.stack([gap, tf], axis=1).reshape(-1)
    data, size = to_bytes(both)
    end = np.cumsum(size)[1::2] if len(own) else np.zeros(0, np.int64)
    b_bytes = np.diff(np.append(0, end[b_end - 1])) if len(b_end) else np.zeros(0, np.int64)
    last = doc[b_end - 1] if len(b_end) else np.zeros(0, np.int64)
    last_gap = last.copy()
    last_gap[1:] -= np.where(b_term[1:] == b_term[:-1], last[:-1], 0)

    # pairs that are not beaten: by length, those with more occurrences than all shorter ones
    order = np.lexsort((-tf, n[doc], b_of))
    high = b_of[order] * (int(tf.max(initial=0)) + 1) + tf[order]
    best = np.append(True, high[1:] > np.maximum.accumulate(high)[:-1]) if len(high) else np.zeros(0, bool)
    best |= np.append(True, b_of[order][1:] != b_of[order][:-1]) if len(high) else best
    chosen = order[best]
    tops = np.bincount(b_of[chosen], minlength=len(b_first))

    def column(values: np.ndarray, owner: np.ndarray) -> pa.Array:
        flat, size = to_bytes(values)
        ends = np.append(0, np.cumsum(size))[np.searchsorted(owner, np.arange(len(term)), side="right")]
        return _cut(flat, ends)

    t_end = np.searchsorted(own, np.arange(len(term)), side="right")
    columns = {
        "term": term,
        "df": pa.array(df, pa.int64()),
        "lasts": column(last_gap, b_term),
        "sizes": column(b_bytes, b_term),
        "tops": column(tops, b_term),
        "pairs": column(np.stack([tf[chosen], n[doc[chosen]]], axis=1).reshape(-1), np.repeat(own[chosen], 2)),
        "data": _cut(data, np.append(0, end)[t_end]),
    }
    return n, columns


@dataclass
class Lists:
    """Posting lists of some terms in one shard, opened as far as their
    headers: blocks of the list k are [first[k], first[k + 1])."""

    first: np.ndarray
    last: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    term: np.ndarray
    top: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, columns: dict[str, list[bytes]], impact) -> Lists:
        """impact(list, tf, n): what a posting of that list is worth."""
        joined = {c: from_bytes(b"".join(columns[c])) for c in ("lasts", "sizes", "tops", "pairs")}
        # a header has one number a block, whose last byte is below 128
        blocks = np.array([int((np.frombuffer(x, np.uint8) < 128).sum()) for x in columns["tops"]], np.int64)
        first = np.append(0, np.cumsum(blocks))
        term = np.repeat(np.arange(len(blocks)), blocks)
        total = np.cumsum(joined["lasts"])
        before = np.append(0, total)[first[:-1]]
        end = np.cumsum(joined["sizes"])
        owner = np.repeat(np.arange(len(term)), joined["tops"])
        tf, n = joined["pairs"][::2], joined["pairs"][1::2]
        worth = impact(term[owner], tf, n)
        top = np.maximum.reduceat(worth, np.cumsum(joined["tops"]) - joined["tops"]) if len(owner) else worth
        return cls(first, total - np.repeat(before, blocks), end - joined["sizes"], end, term, top, np.frombuffer(b"".join(columns["data"]), np.uint8))

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these blocks, decompressed: each posting's block (its place in
        `blocks`), text and frequency."""
        values = from_bytes(np.concatenate([self.data[self.begin[b] : self.end[b]] for b in blocks.tolist()]))
        # two numbers a posting; where a block's numbers end follows from its bytes
        raw = [int((self.data[self.begin[b] : self.end[b]] < 128).sum()) // 2 for b in blocks.tolist()]
        of = np.repeat(np.arange(len(blocks)), raw)
        gap, tf = values[::2], values[1::2]
        before = np.where(self.first[self.term[blocks]] == blocks, 0, self.last[np.maximum(blocks - 1, 0)])
        start = np.cumsum(raw) - raw
        total = np.cumsum(gap)
        doc = total - np.repeat(np.append(0, total)[start], raw) + before[of]
        return of, doc, tf
