"""Normalised word text for Aho-Corasick scans, with places mapped back."""

from __future__ import annotations

import ahocorasick
import numpy as np

from .words import ALNUM, LOWER

#: Word bytes lower-cased, all others a space; as long as the original, so a
#: place in the translated text is the place in the original.
TO_WORDS = bytes(int(LOWER[b]) if ALNUM[b] else 32 for b in range(256))


class Normal:
    """One text: its words, joined by single spaces with one at either end."""

    __slots__ = ("raw", "flat", "words", "text", "_spaces", "_bounds")

    def __init__(self, raw: bytes) -> None:
        self.raw = raw
        self.flat = raw.translate(TO_WORDS)
        parts = self.flat.split()
        self.words = len(parts)
        self.text = (b" " + b" ".join(parts) + b" ").decode("latin-1") if parts else ""
        self._spaces = self._bounds = None

    def word_before(self, end: int) -> int:
        """Words that end at or before this place of the normalised text,
        where a match with its closing space ends."""
        if self._spaces is None:
            self._spaces = np.flatnonzero(np.frombuffer(self.text.encode("latin-1"), np.uint8) == 32)
        return int(np.searchsorted(self._spaces, end))

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte of each word in the original text."""
        if self._bounds is None:
            inside = np.concatenate([[False], np.frombuffer(self.flat, np.uint8) != 32, [False]])
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            self._bounds = edge[::2], edge[1::2]
        return self._bounds


def word_list(raw: bytes) -> list[str]:
    return [w.decode("latin-1") for w in raw.translate(TO_WORDS).split()]


def automaton(phrases: dict[str, object]) -> ahocorasick.Automaton:
    """Of phrases written as words joined by single spaces; each value comes
    back with the place of the phrase's closing space."""
    found = ahocorasick.Automaton()
    for phrase, value in phrases.items():
        found.add_word(f" {phrase} ", value)
    found.make_automaton()
    return found
