"""Personal data: rules find the base spans; high-recall generators propose
more, which may overlap; boosted trees over format and context features score
them, and calibrated thresholds select.  Everything that touches rows is a
Spark expression; the trees are fitted on the driver and become CASE
expressions."""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .shared import named, numbered

_LOCAL = "[A-Za-z0-9._%+-]"
#: Base kinds in the contract's order, and their rules as they are run: the
#: same leftmost matches, but possessive and only tried where a match can
#: begin, so that long runs take linear time and no recursion.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that a text may hold the kind at all.
GATES: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
}
#: Generators of further kinds: any match is a candidate.
GENERATORS = {
    "account": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]?[0-9]{8,12})(?![A-Za-z0-9])",
    "localphone": r"(?<![0-9+])\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    "secret": r"[A-Za-z0-9+/_-]{16,}+={0,2}",
}
KINDS = [*BASE, *GENERATORS]
#: Words of the 32 characters before a candidate.
SECRET_WORDS = r"(?i)(?:token|secret|passw|api.?key|access.?key|bearer|auth)"
ACCOUNT_WORDS = r"(?i)(?:iban|account|konto|compte|cuenta|ssn|social|passport|tax|national id)"
PHONE_WORDS = r"(?i)(?:phone|tel|call|mobile|fax|handy)"
SPAN = "array<struct<start:bigint,end:bigint,value:string>>"
#: Code points of a piece of a text that places are looked up in.
PIECE = 256
#: Steps of a running sum: powers of two up to the longest array.
STEPS = [1 << k for k in range(31)]


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, as a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def running(numbers: Column) -> Column:
    """Sums of the first 1, 2, ... numbers of an array.  In step p each sum
    takes in the one p places before it, so n numbers take n log n steps, and
    no array is copied for each of its elements."""
    steps = lambda a: F.filter(F.array(*map(F.lit, STEPS)), lambda p: p < F.size(a))
    step = lambda a, p: F.transform(a, lambda v, i: v + F.when(i >= p, F.get(a, i - p)).otherwise(F.lit(0).cast("bigint")))
    return _bound(numbers, lambda a: F.aggregate(steps(a), a, step))


def pieces(text: Column) -> Column:
    """The text cut into pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(cut: Column, start: Column, end: Column) -> Column:
    """Code points from start to end of a text in pieces: only the pieces that
    hold them are looked at, wherever in the text they are."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    at = (start - first * PIECE + 1).cast("int")
    over = F.concat(F.get(cut, first).substr(at, F.lit(PIECE)), F.array_join(F.slice(cut, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.left(F.get(cut, last), (end - last * PIECE).cast("int")))
    return F.when(end <= start, "").when(first == last, F.get(cut, first).substr(at, (end - start).cast("int"))).otherwise(over)


def matches(text: Column, pattern: str) -> Column:
    """(start, end, value) of the leftmost non-overlapping matches, in code
    points: the texts between the matches and the matches add up.  Linear in
    the text and, but for a logarithm, in the matches."""
    long = lambda c: F.char_length(c).cast("bigint")
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"), F.split(text, pattern, -1).alias("gap"))
    ends = lambda f: running(F.zip_with(f["v"], F.slice(f["gap"], F.lit(1), F.size(f["v"])), lambda v, g: long(g) + long(v)))
    return _bound(found, lambda f: F.zip_with(ends(f), f["v"], lambda e, v: F.struct((e - long(v)).alias("start"), e.alias("end"), v.alias("value"))))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: every second digit from the right
    doubled, less 9 above 9, the sum divisible by 10."""
    n = F.char_length(digits)
    value = lambda i: digits.substr(n - i + 1, F.lit(1)).cast("int")
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, double(value(i))).otherwise(value(i)))
    return (n > 0) & (total % 10 == 0)


def _byte(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.char_length(short) <= 3) & (F.concat(F.lit("0"), F.left(short, F.lit(3))).cast("int") <= 255)


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _byte),
    "card": lambda v: F.char_length(_digits(v)).between(16, 19) & luhn(_digits(v)),
    "phone": lambda v: F.char_length(_digits(v)).between(8, 15),
}

#: Features of a candidate: name, over its value and the text before it in
#: Spark, and the same in Python for the training set.
FEATURES: list[tuple[str, Callable[[Column, Column], Column], Callable[[str, str], float]]] = [
    ("length", lambda v, c: F.char_length(v), lambda v, c: len(v)),
    ("digits", lambda v, c: F.char_length(_digits(v)), lambda v, c: len(re.sub("[^0-9]", "", v))),
    ("upper", lambda v, c: F.char_length(F.regexp_replace(v, "[^A-Z]", "")), lambda v, c: len(re.sub("[^A-Z]", "", v))),
    ("lower", lambda v, c: F.char_length(F.regexp_replace(v, "[^a-z]", "")), lambda v, c: len(re.sub("[^a-z]", "", v))),
    ("different", lambda v, c: F.size(F.array_distinct(F.split(v, ""))), lambda v, c: len(set(v))),
    ("changes", lambda v, c: F.size(F.regexp_extract_all(v, F.lit("[0-9]+|[A-Za-z]+"), F.lit(0))), lambda v, c: len(re.findall("[0-9]+|[A-Za-z]+", v))),
    ("assigned", lambda v, c: c.rlike("[=:] ?[\"']?$").cast("int"), lambda v, c: int(bool(re.search("[=:] ?[\"']?$", c)))),
    ("secret_word", lambda v, c: c.rlike(SECRET_WORDS).cast("int"), lambda v, c: int(bool(re.search(SECRET_WORDS, c)))),
    ("account_word", lambda v, c: c.rlike(ACCOUNT_WORDS).cast("int"), lambda v, c: int(bool(re.search(ACCOUNT_WORDS, c)))),
    ("phone_word", lambda v, c: c.rlike(PHONE_WORDS).cast("int"), lambda v, c: int(bool(re.search(PHONE_WORDS, c)))),
]


DESCRIBED = "array<struct<start:bigint,end:bigint," + ",".join(f"{name}:double" for name, _, _ in FEATURES) + ">>"


def examples(kind: str, n: int, seed: int) -> tuple[list[tuple[str, str]], list[int]]:
    """Made-up candidates (value, text before) of a kind: personal data, and
    things that look like it."""
    rng = random.Random(f"{kind}-{seed}")
    some = lambda letters, a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    low, num, up = "abcdefghijklmnopqrstuvwxyz", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = lambda: (" ".join(some(low, 2, 9) for _ in range(6)) + " ")[-32:]
    rows, labels = [], []
    for _ in range(n):
        good = rng.random() < 0.5
        if kind == "secret":
            if good:
                value = rng.choice([lambda: some("0123456789abcdef", 32, 64), lambda: some(low + num, 20, 48), lambda: some(low + up + num + "+/_-", 20, 64), lambda: some("0123456789ABCDEF", 32, 64)])()
                word = rng.choice(["token", "TOKEN", "secret", "password", "api_key", "API-KEY", "access_key", "auth"])
                before = plain()[-16:] + word + rng.choice([" = \"", "=", ": ", " = '", ":", "=\""]) if rng.random() < 0.9 else plain()
            else:
                value = rng.choice([lambda: some(low, 16, 40), lambda: some(up, 16, 30), lambda: some("-_", 16, 40), lambda: "_".join(some(rng.choice([low, up]), 3, 9) for _ in range(4)), lambda: "/".join(some(low, 3, 8) for _ in range(4)), lambda: some(num, 16, 24), lambda: "-".join(some(low, 3, 7) for _ in range(4))])()
                before = plain() if rng.random() < 0.9 else plain()[-16:] + rng.choice(["note: ", "a = ", "token ", "author "])
        elif kind == "account":
            if good:
                value = rng.choice([lambda: some(up, 2, 2) + some(num, 16, 22), lambda: f"{some(num, 3, 3)}-{some(num, 2, 2)}-{some(num, 4, 4)}", lambda: some(num, 8, 12)])()
                before = plain()[-12:] + rng.choice(["IBAN ", "iban: ", "account ", "SSN ", "ssn: ", "passport ", "tax id "])
            else:
                value = rng.choice([lambda: some(num, 8, 12), lambda: f"{some(up, 1, 1)}{some(num, 8, 10)}", lambda: some("0123456789", 8, 8)])()
                before = plain()
        else:
            value = rng.choice([lambda: f"({some(num, 3, 3)}) {some(num, 3, 3)}-{some(num, 4, 4)}", lambda: f"{some(num, 3, 3)}-{some(num, 3, 3)}-{some(num, 4, 4)}", lambda: f"0{some(num, 2, 3)} {some(num, 3, 4)} {some(num, 3, 4)}"])()
            if good:
                before = plain()[-16:] + rng.choice(["phone ", "Tel: ", "call ", "mobile ", "fax "])
            else:
                value = value if rng.random() < 0.3 else f"{some(num, 2, 4)}.{some(num, 3, 3)}.{some(num, 3, 3)}"
                before = plain()
        rows.append((value, before))
        labels.append(int(good))
    return rows, labels


@cache
def models(n: int = 600, precision: float = 0.97) -> dict[str, tuple[boosting.Boosted, float]]:
    """Trees and threshold of each generated kind: fitted on n examples, the
    threshold chosen on n others."""
    out = {}
    for kind in GENERATORS:
        table = lambda rows: np.array([[f(v, c) for _, _, f in FEATURES] for v, c in rows], float)
        rows, y = examples(kind, n, 1)
        trees = boosting.fit(table(rows), np.array(y, float))
        rows, y = examples(kind, n, 2)
        out[kind] = trees, boosting.threshold(trees.logit(table(rows)), np.array(y), precision)
    return out


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda s: CHECKS[kind](s["value"])


def _labelled(kind: str, base: bool) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"))


def _passing(trees: boosting.Boosted, least: float) -> Callable[[Column], Column]:
    return lambda s: trees.column(lambda i: s[FEATURES[i][0]]) >= least


def find_personal_data(docs: DataFrame, text_col: str = "text", spans_col: str = "_spans") -> DataFrame:
    """The columns of docs and `_spans`: array of (kind, start, end, base) in
    code points, end exclusive, by kind in the order of KINDS, then start.

    Base spans are what the rules find; a further span is a candidate whose
    score passes its kind's threshold, whether or not it overlaps base spans.
    A null or empty text has no spans.  All in one projection chain, no shuffle.
    """
    none = F.array().cast(SPAN)
    names = docs.columns
    out = numbered(docs).withColumn("_t", F.coalesce(F.col(f"c{names.index(text_col)}").cast("string"), F.lit("")))
    for kind, pattern in BASE.items():
        out = out.withColumn(f"_{kind}", F.filter(F.when(GATES[kind](F.col("_t")), matches(F.col("_t"), pattern)).otherwise(none), _checked(kind)))
    out = out.withColumn("_base", F.concat(*[F.transform(f"_{k}", _labelled(k, True)) for k in BASE]))
    for kind, pattern in GENERATORS.items():
        trees, least = models()[kind]
        found = F.when(F.col("_t").rlike(pattern), matches(F.col("_t"), pattern)).otherwise(none)

        def described(s: Column, before: Column) -> Column:
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), *[f(s["value"], before).cast("double").alias(name) for name, f, _ in FEATURES])

        def all_described(spans: Column) -> Column:
            each = lambda cut: F.transform(spans, lambda s: _bound(between(cut, F.greatest(s["start"] - 32, F.lit(0)), s["start"]), lambda before: described(s, before)))
            return F.when(F.size(spans) > 0, _bound(pieces(F.col("_t")), each)).otherwise(F.array().cast(DESCRIBED))

        out = out.withColumn(f"_{kind}", _bound(found, all_described))
        out = out.withColumn(f"_{kind}", F.filter(f"_{kind}", _passing(trees, least)))
    more = [F.transform(f"_{k}", _labelled(k, False)) for k in GENERATORS]
    return named(out.withColumn(spans_col, F.concat("_base", *more)), names, spans_col)


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each
    row; a null text counts as empty, null ids stay, repeated rows give
    repeated rows, an empty table gives none; other columns are not read."""
    found = find_personal_data(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda k: F.size(F.filter("_spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(written(F.filter("_spans", lambda s: s["base"])), 256).alias("base_sha256"), written(F.col("_spans")).alias("spans"))


def _running_largest(numbers: Column) -> Column:
    """The largest of the first 1, 2, ... numbers, as in `running`."""
    steps = lambda a: F.filter(F.array(*map(F.lit, STEPS)), lambda p: p < F.size(a))
    step = lambda a, p: F.transform(a, lambda v, i: F.greatest(v, F.coalesce(F.get(a, i - p), v)))
    return _bound(numbers, lambda a: F.aggregate(steps(a), a, step))


def _group_ends(marked: Column) -> Column:
    """What is reached at the end of each group: before the next first span,
    and at the last span."""
    n = F.size(marked)
    last = lambda s, i: (i == n - 1) | F.coalesce(F.get(marked, i + 1)["first"], F.lit(False))
    return F.transform(F.filter(marked, last), lambda s: s["reach"])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each found span of the text replaced by its kind in brackets;
    of spans that overlap the first, and of those the longest, stands for
    all.  A null text stays null."""
    names = docs.columns
    place = f"c{names.index(text_col)}"
    found = find_personal_data(numbered(docs), place)
    text = F.col(place)
    # the first and then the longest of spans that overlap: no span before it reaches beyond its start
    order = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("least"), s["end"].alias("end"), s["kind"].alias("kind"))))
    reach = lambda o: _running_largest(F.transform(o, lambda s: s["end"]))
    marked = lambda o: _bound(reach(o), lambda r: F.transform(o, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(r, i).alias("reach"), (F.coalesce(F.get(r, i - 1), F.lit(0)) <= s["start"]).alias("first"), s["kind"].alias("kind"))))
    # each first one with where its group ends, which is what is reached before the next first one
    groups = lambda m: _bound(F.filter(m, lambda s: s["first"]), lambda firsts: _bound(_group_ends(m), lambda ends: F.zip_with(firsts, ends, lambda s, e: F.struct(s["start"].alias("start"), e.alias("end"), s["kind"].alias("kind")))))

    def written_out(g: Column, cut: Column) -> Column:
        own = F.transform(g, lambda s, i: F.concat(between(cut, F.coalesce(F.get(g, i - 1)["end"], F.lit(0).cast("bigint")), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(own, ""), between(cut, F.element_at(g, -1)["end"], F.char_length(text).cast("bigint")))

    replaced = _bound(order, lambda o: _bound(marked(o), lambda m: _bound(groups(m), lambda g: _bound(pieces(text), lambda cut: written_out(g, cut)))))
    new = F.when(F.size("_spans") == 0, text).otherwise(replaced)
    return named(found.withColumn(place, F.when(text.isNotNull(), new)), names)
