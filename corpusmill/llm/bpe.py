"""Byte-level byte-pair encoding by rank-synchronous array merging.

Many pre-tokens are held at once as one flat array of symbols with sequence
starts.  In every round each sequence finds its lowest-ranked adjacent pair
and merges all its occurrences from left to right, all sequences at the same
time; sequences with nothing left to merge leave the array.  That equals the
one-merge-at-a-time definition because a merge only makes a symbol whose own
merges rank later than the one that made it.
"""

from __future__ import annotations

import json

import numpy as np
import regex

from .words import _BASE, _BYTES, _INVERSE, U, _powers, mix

#: Classes of characters in the published pre-tokenisation rule.
OTHER, SPACE, LETTER, NUMBER, EDGE = range(5)
#: Contractions that are pre-tokens of their own.
SHORT, LONG = "stmd", ("re", "ve", "ll")


class _Classes:
    """Class of each code point, filled by page as pages are met."""

    PATTERNS = [(k, regex.compile(p)) for k, p in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"))]

    def __init__(self) -> None:
        self.table = np.zeros(0x110000, np.uint8)
        self.met = np.zeros(0x110000 >> 8, bool)

    def of(self, cp: np.ndarray) -> np.ndarray:
        pages = np.flatnonzero(np.bincount(cp >> 8, minlength=len(self.met)))
        for page in pages[~self.met[pages]].tolist():
            text = "".join(map(chr, range(page << 8, (page + 1) << 8)))
            for kind, pattern in self.PATTERNS:
                for m in pattern.finditer(text):
                    self.table[(page << 8) + m.start() : (page << 8) + m.end()] = kind
            self.met[page] = True
        return self.table[cp]


_classes = _Classes()


def pre_tokens(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The joined UTF-8 bytes, and each pre-token's first and end byte there
    and text number.

    The rule, tried in this order at each place: a contraction ('s 't 're 've
    'm 'll 'd); letters, numbers or other visible characters, each with at
    most one space before; white space up to but without its last character
    if something follows; white space.
    """
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    kind = _classes.of(cp)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind[ends] = EDGE
    n = len(cp)
    begin = np.ones(n + 4, bool)
    np.not_equal(kind[1:], kind[:-1], out=begin[1:n])
    blank = np.concatenate([[False], (cp == 32)[:-1]])  # a space before
    visible = (kind != SPACE) & (kind != EDGE)
    head = np.flatnonzero(begin[:n] & visible)
    after = head[head > 0]
    after = after[kind[after - 1] == SPACE]
    begin[after - 1] = True  # the last of the white space stands alone ...
    begin[after[blank[after]]] = False  # ... or begins what follows
    quote = head[(cp[head] == 39) & ~blank[head]]
    quote = quote[kind[quote + 1] == LETTER]
    one, two = cp[quote + 1], cp[np.minimum(quote + 2, n - 1)]
    short = quote[np.isin(one, [ord(c) for c in SHORT])]
    long = quote[np.logical_or.reduce([(one == ord(x)) & (two == ord(y)) for x, y in LONG])]
    begin[short + 1] = begin[long + 1] = begin[long + 2] = False
    begin[short + 2] = begin[long + 3] = True
    start = np.flatnonzero(begin[:n])
    end = np.append(start[1:], n)
    real = kind[start] != EDGE
    start, end = start[real], end[real]
    width = (1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)).astype(np.int64) if cp.max() >= 0x80 else np.ones(n, np.int64)
    at = np.concatenate([[0], np.cumsum(width)])
    return joined.encode(), at[start], at[end], np.searchsorted(ends, start)


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(extra)) for b in range(256)]


class Bpe:
    """A tokenizer file's merges as sorted arrays, and a bounded memory of
    pre-tokens already encoded."""

    MEMORY = 250_000
    BITS = 18

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_ids = np.array([vocab[c] for c in _byte_symbols()], dtype=np.int64)
        self.n = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.none = np.int64(len(keys))
        # by rank; the last entry is an empty slot of the hash table below
        self.keys, self.made = np.append(keys, -1), np.append(made, 0)
        self.table = np.full(1 << self.BITS, self.none)
        mask, slots = (1 << self.BITS) - 1, ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).tolist()
        taken = set()
        for r, slot in enumerate(slots):
            while slot in taken:
                slot = (slot + 1) & mask
            taken.add(slot)
            self.table[slot] = r
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.known: dict[int, bytes] = {}

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and the symbol that it makes; the number of
        merges is the rank of a pair that never merges."""
        key = left * self.n + right
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)
        at = self.table[slot.astype(np.int64)]
        todo = np.flatnonzero(self.keys[at] != key)
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & np.uint64((1 << self.BITS) - 1)
            at[todo] = self.table[slot[todo].astype(np.int64)]
            found = self.keys[at[todo]]
            todo = todo[(found != key[todo]) & (found >= 0)]
        hit = self.keys[at] == key
        return np.where(hit, at, self.none), np.where(hit, self.made[at], 0)

    def merge(self, tokens: list[bytes]) -> list[bytes]:
        """Symbol ids of each pre-token, little-endian unsigned 32-bit."""
        out = [b""] * len(tokens)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        live = np.flatnonzero(sizes)
        symbol = self.byte_ids[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        seq = np.repeat(live, sizes[live])
        rank, new = np.full(len(symbol), self.none), np.zeros(len(symbol), np.int64)
        changed = np.arange(len(symbol))  # positions whose pair must be looked up
        while len(symbol):
            rank[changed] = self.none
            near = changed[changed < len(symbol) - 1]
            near = near[seq[near] == seq[near + 1]]
            rank[near], new[near] = self._lookup(symbol[near], symbol[near + 1])
            starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            length = np.diff(np.append(starts, len(seq)))
            low = np.minimum.reduceat(rank, starts)
            over = low == self.none
            keep = None
            if over.any():
                done = symbol.astype("<u4").tobytes()
                for k, s, e in zip(seq[starts[over]].tolist(), (4 * starts[over]).tolist(), (4 * (starts + length)[over]).tolist(), strict=True):
                    out[k] = done[s:e]
                keep = np.repeat(~over, length)
            # of pairs that overlap (a a a), take the first, third, ...
            run = np.flatnonzero((rank == np.repeat(low, length)) & (rank != self.none))
            tight = np.concatenate([[False], np.diff(run) == 1])
            if tight.any():
                order = np.arange(len(run))
                run = run[(order - np.maximum.accumulate(np.where(tight, 0, order))) % 2 == 0]
            symbol[run] = new[run]
            keep = np.ones(len(symbol), bool) if keep is None else keep
            keep[run + 1] = False
            place = np.cumsum(keep) - 1
            symbol, seq, rank, new = symbol[keep], seq[keep], rank[keep], new[keep]
            at = place[run]
            before = at[at > 0] - 1
            changed = np.concatenate([at, before])
        return out

    def _segments(self, texts: list[str]) -> tuple[list[str], np.ndarray, dict[int, list[int]]]:
        """Plain segments between special tokens, the text of each, and the
        special ids of the texts that hold any.  Their string in a text is
        that token, as the library has it by default."""
        plain, owner, special = [], [], {}
        for i, t in enumerate(texts):
            pieces = self.cut(t) if self.cut and any(s in t for s in self.special) else [t]
            if len(pieces) > 1:
                special[i] = [self.special[s] for s in pieces[1::2]]
            plain += pieces[::2]
            owner += [i] * len(pieces[::2])
        return plain, np.array(owner, np.int64), special

    def _encode(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of each different pre-token of the texts, and of every
        pre-token its number among them and its text.  They are told apart by
        64-bit hashes."""
        raw, start, end, text = pre_tokens(texts)
        buf = np.frombuffer(raw, np.uint8)
        total = np.zeros(len(buf) + 1, U)
        np.cumsum(_BYTES[buf] * _powers(_BASE, len(buf)), out=total[1:])
        h = mix((total[end] - total[start]) * _powers(_INVERSE, len(buf))[start] + (end - start).astype(U))
        unique, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        keys = unique.tolist()
        if len(self.known) + len(keys) > self.MEMORY:
            self.known.clear()
        missing = [i for i, k in enumerate(keys) if k not in self.known]
        if missing:
            at = where[missing]
            self.known.update(zip([keys[i] for i in missing], self.merge([raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]), strict=True))
        return [self.known[k] for k in keys], inverse, text

    def count_many(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each whole text."""
        plain, owner, special = self._segments(texts)
        out = np.zeros(len(texts), np.int64)
        if plain:
            ids, inverse, segment = self._encode(plain)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            out += np.bincount(owner[segment], weights=sizes[inverse], minlength=len(texts)).astype(np.int64)
        for i, s in special.items():
            out[i] += len(s)
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers."""
        plain, owner, special = self._segments(texts)
        if not plain:
            return []
        ids, inverse, segment = self._encode(plain)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        many = sizes[inverse]
        ends = np.cumsum(many)
        made = flat[np.repeat(first[inverse] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]
        bound = np.concatenate([[0], ends])[np.searchsorted(segment, np.arange(len(plain) + 1))]
        made, bound = made.tobytes(), (4 * bound).tolist()
        out = [b""] * len(texts)
        left = {i: iter(s) for i, s in special.items()}
        for k, i in enumerate(owner.tolist()):
            if k and owner[k - 1] == i:
                out[i] += next(left[i]).to_bytes(4, "little")
            out[i] += made[bound[k] : bound[k + 1]]
        return out


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The tokenizer of a file, once in each worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]
