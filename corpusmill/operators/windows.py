"""Words of whole texts and hashes of their runs, in numpy over the bytes of
Arrow batches: what `functions.text` has as expressions, for whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

#: Bytes of texts that are looked at at once; a longer text, or word, is by
#: itself.
AT_ONCE = 1 << 18

Texts = tuple[np.ndarray, np.ndarray]
Hashes = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _pieces(at_once: int) -> Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, Texts]]]:
    """A function that cuts a batch, its last column texts without nulls, into
    pieces: each with its texts' bytes and the offsets of these.  Here and
    below functions are made inside functions, so they travel by value and the
    workers need not find this package."""

    def pieces(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Texts]]:
        text = b.column(b.num_columns - 1).cast(pa.large_binary())
        ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
        cuts = np.flatnonzero(np.diff((ends[:-1] - ends[0]) // at_once, prepend=-1, append=-1))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.slice(low, high - low), (data[ends[low] : ends[high]], ends[low : high + 1] - ends[low])

    return pieces


def _edges() -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function from the bytes that belong to words, and the offsets of the
    texts, to where words start and end; no word goes from text to text."""

    def edges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        at = offsets[offsets < len(inside)]
        first[at] = inside[at]
        at = offsets[offsets > 0] - 1
        last[at] = inside[at]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    return edges


def _hashes(n: int, at_once: int) -> Callable[[Texts], Hashes]:
    """A function from lower-case texts to (h, of, words, whole): hashes of
    their runs of n words between white space, in order, and whose they are;
    their numbers of words; a hash of the whole sequence of words of those
    with fewer than n.  These are the words of the normalised text."""
    edges, u = _edges(), np.uint64
    base, step = 0x9E3779B97F4A7C15, u(0xD1342543DE82EF95)
    powers: dict[int, np.ndarray] = {}

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
        return x ^ (x >> u(31))

    def power(of: int, size: int) -> np.ndarray:
        if len(powers.get(of, ())) < size:
            out = np.ones(max(size, at_once), dtype=u)
            done = 1
            while done < len(out):
                take = min(done, len(out) - done)
                out[done : done + take] = out[:take] * u(pow(of, done, 1 << 64))
                done += take
            powers[of] = out
        return powers[of][:size]

    def hashes(texts: Texts) -> Hashes:
        data, offsets = texts
        codes = mix(np.arange(1, 257, dtype=u) * step)
        inside = np.ones(256, dtype=bool)
        inside[[9, 10, 11, 12, 13, 32]] = False
        start, end = edges(inside[data], offsets)
        word = np.empty(len(start), dtype=u)
        cuts = np.flatnonzero(np.diff(start // at_once, prepend=-1, append=-1))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):  # a polynomial of a word's bytes, from running sums
            s, e = start[low:high] - start[low], end[low:high] - start[low]
            total = np.zeros(e[-1] + 1, dtype=u)
            np.cumsum(codes[data[start[low] : end[high - 1]]] * power(base, e[-1]), out=total[1:])
            word[low:high] = mix((total[e] - total[s]) * power(pow(base, -1, 1 << 64), e[-1])[s] + (e - s).astype(u) * step)
        of_text = np.searchsorted(start, offsets)
        first, words = of_text[:-1], np.diff(of_text)
        at = np.flatnonzero(np.repeat(of_text[1:], words) - np.arange(len(word)) >= n)
        h = np.full(len(at), n, dtype=u)
        for k in range(n):
            h = (h ^ word[at + k]) * step
            h ^= h >> u(32)
        whole = mix(words.astype(u) + u(1))
        for k in range(n - 1):
            on = (words < n) & (words > k)
            whole[on] = mix(whole[on] * step + word[first[on] + k])
        return mix(h), np.repeat(np.arange(len(words)), np.maximum(words - n + 1, 0)), words, whole

    return hashes


@dataclass
class Sets:
    """How the sets of different windows of n words are made of texts."""

    n: int
    at_once: int = AT_ONCE

    def _map(self, rows: DataFrame, made: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
        """What `made` makes of rows (id, text) and their sets: (h, starts,
        whole), h in order within a set, a set from one start to the next, whole
        as of `_hashes`."""
        pieces, hashes = _pieces(self.at_once), _hashes(self.n, self.at_once)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, texts in pieces(b):
                    h, of, words, whole = hashes(texts)
                    starts = np.searchsorted(of, np.arange(len(words) + 1))
                    for low, high in zip(starts[:-1], starts[1:], strict=True):
                        h[low:high].sort()
                    new = np.ones(len(h), dtype=bool)
                    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                    yield made(part, h[new], np.concatenate([[0], np.cumsum(new)])[starts], whole)

        return rows.select("id", F.lower("text").alias("text")).mapInArrow((lambda batches: then(run(batches))) if then else run, schema)

    def keys(self, rows: DataFrame) -> DataFrame:
        """(id, k1, k2): two hashes of a row's set; of its text, if that has
        fewer than n words."""
        made = _keyed()
        return self._map(rows, lambda part, h, starts, whole: pa.RecordBatch.from_arrays([part.column(0), *made(h, starts, whole)], names=["id", "k1", "k2"]), "id bigint, k1 bigint, k2 bigint")

    def whole(self, rows: DataFrame, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str = "id bigint, s array<bigint>") -> DataFrame:
        """(id, s): a row's set; or what `then` makes of batches of these."""

        def made(part: pa.RecordBatch, h: np.ndarray, starts: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(starts.astype(np.int32), h.view(np.int64))], names=["id", "s"])

        return self._map(rows, made, schema, then)

    def first(self, rows: DataFrame, percent: int, bits: list[int]) -> DataFrame:
        """(id, k1, k2, n, first): a row's keys, the size of its set and the
        elements of which a set with that similarity must have one among its
        own: unmarked ones first, marks as `links.frequent` makes them."""
        keyed, marks = _keyed(), np.array(bits, dtype=np.int64).view(np.uint64)

        def made(part: pa.RecordBatch, h: np.ndarray, starts: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
            u, size = np.uint64, np.diff(starts)
            most = np.where(size > 0, size + (-percent * size) // 100 + 1, 0)
            slot = h & u(64 * len(marks) - 1)
            often = (marks[(slot >> u(6)).astype(np.int64)] >> (slot & u(63)) & u(1)).astype(bool)
            before = np.concatenate([[0], np.cumsum(often)])
            of = np.repeat(np.arange(len(size)), size)
            place_often = before[:-1] - before[starts[of]]
            place_rare = np.arange(len(h)) - starts[of] - place_often
            rare = size - (before[starts[1:]] - before[starts[:-1]])
            kept = np.where(often, place_often + np.minimum(rare, most)[of], place_rare) < most[of]
            ends = np.concatenate([[0], np.cumsum(kept)])[starts].astype(np.int32)
            return pa.RecordBatch.from_arrays([part.column(0), *keyed(h, starts, whole), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(ends, h[kept].view(np.int64))], names=["id", "k1", "k2", "n", "first"])

        return self._map(rows, made, "id bigint, k1 bigint, k2 bigint, n int, first array<bigint>")


def _keyed() -> Callable[[np.ndarray, np.ndarray, np.ndarray], list[pa.Array]]:
    """A function from sets, as `Sets._map` has them, to their two keys, sums
    of what two ways of mixing make of the elements."""

    def keyed(h: np.ndarray, starts: np.ndarray, whole: np.ndarray) -> list[pa.Array]:
        u, out = np.uint64, []
        for one, other in ((0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)):
            x, w = ((y ^ (y >> u(29))) * u(one) for y in (h, whole))
            x, w = ((y ^ (y >> u(32))) * u(other) for y in (x, w))
            total = np.concatenate([np.zeros(1, dtype=u), np.cumsum(x ^ (x >> u(31)), dtype=u)])
            out.append(pa.array(np.where(np.diff(starts) > 0, total[starts[1:]] - total[starts[:-1]], w ^ (w >> u(31))).view(np.int64)))
        return out

    return keyed


def windows(rows: DataFrame, n: int, short: bool = False, passing: tuple[list[int], int] | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """(id, g) of the windows of n words of rows (id, text), repeats within a
    text left out, g their hashes; with `short`, of a text of fewer words the
    hash of all of them.  `passing`, a Bloom filter's words and its size in
    bits, leaves out what is not in it."""
    pieces, hashes = _pieces(at_once), _hashes(n, at_once)
    words = np.array(passing[0], dtype=np.int64).view(np.uint64) if passing else None
    size = passing[1] if passing else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = np.uint64
        for b in batches:
            for part, texts in pieces(b):
                h, of, counts, whole = hashes(texts)
                if short:
                    few = np.flatnonzero(counts < n)
                    h, of = np.concatenate([h, whole[few]]), np.concatenate([of, few])
                if words is not None:
                    for k in (0, 20, 41):  # the places of bloom()
                        p = (h >> u(k)) & u(size - 1)
                        on = (words[(p >> u(6)).astype(np.int64)] >> (p & u(63)) & u(1)).astype(bool)
                        h, of = h[on], of[on]
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of[new])), pa.array(h[new].view(np.int64))], names=["id", "g"])

    chosen = rows.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return chosen.mapInArrow(run, StructType([chosen.schema["id"]]).add("g", LongType()))


def with_word_count(rows: DataFrame, text: str, name: str, at_once: int = AT_ONCE) -> DataFrame:
    """The rows with, instead of a column of texts, how many words each has, at
    Unicode white space of any kind, as `text.word_count` counts them; null has
    none."""
    kept = rows.drop(text)
    pieces, edges = _pieces(at_once), _edges()
    columns = [*kept.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = np.ones(256, dtype=bool)
        plain[[*range(9, 14), *range(28, 33)]] = False
        for b in batches:
            for part, (data, offsets) in pieces(b):
                inside = plain[data]
                for lead, follow in ((0xC2, [b"\x85", b"\xa0"]), (0xE1, [b"\x9a\x80"]), (0xE2, [*(bytes([0x80, x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"]), (0xE3, [b"\x80\x80"])):
                    at = np.flatnonzero(data == lead)
                    width = len(follow[0])
                    at = at[at + width < len(data)]
                    rest = sum(data[at + 1 + k].astype(np.int64) << (8 * (width - 1 - k)) for k in range(width))
                    for k in range(width + 1):
                        inside[at[np.isin(rest, [int.from_bytes(f) for f in follow])] + k] = False
                start, _ = edges(inside, offsets)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(np.searchsorted(start, offsets)).astype(np.int64))], names=columns)

    given = rows.select(*kept.columns, F.coalesce(text, F.lit("")).alias("_text"))
    return given.mapInArrow(run, StructType([*kept.schema.fields]).add(name, LongType()))
