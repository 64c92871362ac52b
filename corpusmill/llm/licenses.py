"""Licence scans: one Aho-Corasick automaton finds identifier tags and notice
phrases; a shunting-yard parser evaluates and/or/with expressions."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .normal import Normal, automaton
from .shared import batch_of, slices, texts_of

#: Phrases of the contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notice phrases beyond the base, as normalised words: label and weight.
NOTICES = {
    "apache license version 2 0": ("apache-2.0", 0.95),
    "licensed under the apache license": ("apache-2.0", 0.9),
    "mit license": ("mit", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "gnu general public license": ("gpl", 0.95),
    "gnu general public license version 2": ("gpl-2.0", 0.95),
    "gnu general public license version 3": ("gpl-3.0", 0.95),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "isc license": ("isc", 0.8),
    "the unlicense": ("unlicense", 0.8),
    "public domain": ("public-domain", 0.5),
    "cc0": ("cc0-1.0", 0.8),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by nc sa": ("cc-by-nc-sa", 0.9),
    "cc by nc nd": ("cc-by-nc-nd", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
}
BASE_WEIGHTS = {"cc-by": 0.8, "gpl": 0.9, "reserved": 0.6}
#: Tags after which, behind a colon or an equals sign, a licence expression
#: stands on the same line, and the label where none does.
TAGS = {"spdx license identifier": "expression-invalid", "license expression": ""}
_LINE_END = re.compile(rb"[\r\n]")
_OPENING = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")

#: How strict each known family is, from public domain (0) to reserved (4).
STRICTNESS = {"cc0": 0, "unlicense": 0, "0bsd": 0, "wtfpl": 0, "mit": 1, "bsd": 1, "isc": 1, "apache": 1, "cc-by": 1, "zlib": 1, "x11": 1, "ncsa": 1, "artistic": 1, "bsl": 1, "postgresql": 1, "python": 1, "psf": 1, "unicode": 1, "openssl": 1, "libpng": 1, "curl": 1, "mpl": 2, "lgpl": 2, "epl": 2, "cddl": 2, "eupl": 2, "ofl": 2, "ms-pl": 2, "ms-rl": 2, "gpl": 3, "agpl": 3, "sspl": 3, "cc-by-sa": 3, "cc-by-nc": 4, "cc-by-nd": 4, "busl": 4}
_TOKEN = re.compile(rb"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
#: Shapes of identifiers without a known family: a dotted version at the end,
#: or a reference.
_SHAPE = re.compile(r"[a-z][a-z0-9]*(?:-[a-z0-9]+)*-v?\d+(?:\.\d+)+(?:-only|-or-later)?\+?|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
_EXCEPTION = re.compile(r"[a-z0-9.-]*exception[a-z0-9.-]*|[a-z][a-z0-9]*(?:-[a-z0-9]+)*-v?\d+(?:\.\d+)+")
#: Operators from the loosest to the tightest.
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def _family(name: str) -> str | None:
    fit = [k for k in STRICTNESS if name == k or name.startswith(f"{k}-")]
    return max(fit, key=len) if fit else None


def is_identifier(word: str) -> bool:
    """Whether a word is a licence identifier: a known family, alone and not
    written like a plain word, or with a tail that has a digit; or a word of
    an identifier's shape."""
    name = word.lower().rstrip("+")
    family = _family(name)
    if family == name:
        return word != name or not name.isalpha()
    return family is not None and any(c.isdigit() for c in name[len(family) :]) or _SHAPE.fullmatch(word.lower()) is not None


@dataclass(frozen=True)
class Terms:
    """What an expression comes to: its licences and the strictness that must
    be met, which is the mildest choice of an `or` and the strictest part of
    an `and`; an exception (`with`) makes a licence one step milder."""

    ids: frozenset[str]
    strictness: int


def _strictness(name: str) -> int:
    family = _family(name)
    return 4 if family is None else STRICTNESS[family]


def parse(raw: bytes, start: int = 0, stop: int | None = None) -> tuple[Terms | None, int]:
    """Evaluate the longest run from start on that is a licence expression, by
    the shunting-yard algorithm: the terms and the place where it ends, or
    None and start where none stands.  Identifiers are those that look like
    licences, so prose gives none; an `and` before prose ends the expression."""
    values: list[Terms] = []
    ops: list[str] = []
    stop = len(raw) if stop is None else stop
    best: tuple[Terms | None, int] = (None, start)
    want_value, at = True, start

    def reduce_top(values: list[Terms], op: str) -> None:
        b, a = values.pop(), values.pop()
        ids = a.ids | b.ids
        if op == "with":
            ids = a.ids | frozenset(f"exception:{x}" for x in b.ids)
        values.append(Terms(ids, {"or": min(a.strictness, b.strictness), "and": max(a.strictness, b.strictness), "with": max(a.strictness - 1, 0)}[op]))

    while m := _TOKEN.match(raw, at, stop):
        paren, word = (x and x.decode() for x in m.groups())
        if paren == "(" and want_value and (not ops or ops[-1] != "with"):
            ops.append("(")
        elif paren == ")" and not want_value and "(" in ops:
            while ops[-1] != "(":
                reduce_top(values, ops.pop())
            ops.pop()
        elif word and word.lower() in PRECEDENCE and not want_value:
            op = word.lower()
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[op]:
                reduce_top(values, ops.pop())
            ops.append(op)
            want_value = True
            at = m.end()
            continue
        elif word and want_value and word.lower() not in PRECEDENCE:
            word = word.rstrip(".:")
            excepted = ops and ops[-1] == "with"
            # the last word of a line may be written in any way: nothing of a sentence follows
            alone = not raw[m.end() : min(stop, m.end() + 80)].strip(b" \t\r\"'*/#;,.-<>!") and _family(word.lower()) == word.lower()
            if not (_EXCEPTION.fullmatch(word.lower()) if excepted else is_identifier(word) or alone):
                break
            values.append(Terms(frozenset([word.lower()]), _strictness(word.lower())))
        else:
            break
        want_value = paren == "("
        at = m.end()
        if not want_value and "(" not in ops:
            rest, pending = list(values), list(ops)
            while pending:
                reduce_top(rest, pending.pop())
            best = (rest[0], at)
    return best


@dataclass
class Scan:
    words: int
    base: list[tuple[int, int, str]]  # first word, words, label
    labels: dict[str, float]
    expressions: list[tuple[str, Terms | None]]


def machine():
    """The automaton of all phrases and tags."""
    phrases: dict[str, list[tuple[str, str, float, int]]] = {}
    for p, label in BASE.items():
        phrases.setdefault(p, []).append(("base", label, BASE_WEIGHTS[label], len(p.split())))
    for p, (label, weight) in NOTICES.items():
        phrases.setdefault(p, []).append(("notice", label, weight, len(p.split())))
    for p, label in TAGS.items():
        phrases.setdefault(p, []).append(("tag", label, 0.0, len(p.split())))
    return automaton(phrases)


def scan(raw: bytes, found) -> Scan:
    """All places of base phrases, the labels with their best weight, and the
    evaluated expressions behind tags."""
    doc = Normal(raw)
    out = Scan(doc.words, [], {}, [])
    if not doc.text:
        return out
    ends = [m.start() for m in _LINE_END.finditer(raw)] if any(t in doc.text for t in TAGS) else []
    for end, values in found.iter(doc.text):
        last = doc.word_before(end)
        for kind, label, weight, n in values:
            if kind == "tag":
                m = _OPENING.match(raw, int(doc.bounds()[1][last - 1]))
                if not m:
                    continue
                k = bisect_left(ends, m.end())
                terms, stop = parse(raw, m.end(), ends[k] if k < len(ends) else len(raw))
                if terms or label:
                    out.expressions.append((raw[m.end() : stop].decode("utf-8", "replace").strip(), terms))
                for x in terms.ids if terms else filter(None, [label]):
                    out.labels[x] = max(out.labels.get(x, 0), 1.0 if terms else 0.3)
                continue
            if kind == "base":
                out.base.append((last - n, n, label))
            out.labels[label] = max(out.labels.get(label, 0), weight)
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, strictness, expressions) of each row.

    score is how sure a licence notice is: 1 less the product of each label's
    doubt, 0 without labels.  strictness: the strictest evaluated expression,
    null without one; expressions: their texts.  One map without a shuffle.
    A null or empty text has no words, no labels and score 0; null ids stay;
    repeated rows give repeated rows; other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("strictness", pa.int32()), ("expressions", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = machine()
        for b in slices(batches, "text"):
            rows: dict[str, list] = {f.name: [] for f in schema}
            rows["doc_id"] = b.column("doc_id").to_pylist()
            for raw in texts_of(b.column("text")):
                s = scan(raw, found)
                starts = [x[0] for x in s.base]
                doubt = 1.0
                for label in sorted(s.labels):
                    doubt *= 1 - s.labels[label]
                strict = [t.strictness for _, t in s.expressions if t]
                for k, v in (("n_words", s.words), ("n_base", len(s.base)), ("first_word", min(starts, default=None)), ("last_word", max(starts, default=None)), ("base_labels", ",".join(sorted({x[2] for x in s.base}))), ("labels", ",".join(sorted(s.labels))), ("score", 1 - doubt), ("strictness", max(strict, default=None)), ("expressions", [x for x, _ in s.expressions])):
                    rows[k].append(v)
            yield batch_of(schema, **rows)

    return source.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, strictness int, expressions array<string>")
