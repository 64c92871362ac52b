"""Text expressions: hashing, token counts, reasoning and reply channels,
numbers, delimited spans.  All are Spark columns, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that Python's str.strip() removes, for Java patterns.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode white space included."""
    return F.regexp_replace(F.regexp_replace(text, rf"\A{SPACE}+", ""), rf"{SPACE}+\z", "")


def lines(text: Column) -> Column:
    """The lines of a text as Python's splitlines() has them: every Unicode
    line end counts, and the end of the last line opens no further one."""
    ends = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
    parts = F.split(text, ends, -1)
    return bound(parts, lambda p: F.when(F.get(p, F.size(p) - 1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def float_text(text: Column) -> Column:
    """The number that Python's float() reads, or null (FLT-04): padding,
    exponents, inf and nan in any case, and single underscores between
    digits; no type suffixes."""
    clean = strip(text)
    number = r"\A[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?\z"
    special = F.lower(F.regexp_replace(clean, r"\A[+-]", ""))
    sign = F.when(clean.startswith("-"), -1.0).otherwise(1.0)
    return F.when(clean.rlike(number), F.replace(clean, F.lit("_"), F.lit("")).try_cast("double")).when(special.isin("inf", "infinity"), sign * F.lit(float("inf"))).when(special == "nan", F.lit(float("nan")))


def normalised(text: Column) -> Column:
    """Lower case, runs of white space one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n\f\x{0b}]+", " "))


def content_hash(text: Column) -> Column:
    """sha256 of the normalised text, for exact overlap joins (FN-11, FN-28)."""
    return F.sha2(normalised(text), 256)


def word_count(text: Column) -> Column:
    """White-space words, at Unicode white space of any kind: the token count
    where no tokenizer is given (FN-09)."""
    clean = F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))
    return F.when(F.coalesce(clean, F.lit("")) == "", 0).otherwise(F.size(F.split(clean, " "))).cast("long")


def split_reasoning(text: Column) -> tuple[Column, Column]:
    """Reasoning and content around the first closing think tag; without one
    there is no reasoning (FN-06)."""
    place = F.instr(text, "</think>")
    before, after = text.substr(F.lit(1), place - 1), text.substr(place + 8, F.char_length(text))
    found = place > 0
    return F.when(found, strip(F.regexp_replace(before, r"\A<think>", ""))).otherwise(F.lit("")), strip(F.when(found, after).otherwise(text))


#: Markers of channel-formatted completions.
CHANNEL = "to=user"
MARKERS = ["<|message|>", "<|eom|>", "<|eot|>", "<|start|>", "assistant", "to=self"]
ENDS = ["<|eom|>", "<|eot|>", "<|start|>"]


def split_channels(text: Column) -> tuple[Column, Column]:
    """Reasoning before and reply after the last reply marker; without one
    all is reasoning (FN-20).  A null completion gives two empty texts."""
    text = F.coalesce(text, F.lit(""))
    found = text.contains(CHANNEL)
    reply = F.substring_index(text, CHANNEL, -1)
    before = text.substr(F.lit(1), F.char_length(text) - F.char_length(reply) - len(CHANNEL))
    for m in MARKERS:
        before = F.replace(before, F.lit(m), F.lit(" "))
    reply = F.replace(reply, F.lit("<|message|>"), F.lit(""))
    for m in ENDS:
        reply = F.substring_index(reply, m, 1)
    return F.when(found, strip(before)).otherwise(strip(text)), F.when(found, strip(reply)).otherwise(F.lit(""))


def numbers(text: Column) -> Column:
    """All decimal numbers of a text, as strings (FN-21)."""
    return F.regexp_extract_all(text, F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def bare_number(text: Column) -> Column:
    """Whether a text is one number after trimming white space of any kind and
    dropping commas (FLT-03)."""
    return F.replace(strip(text), F.lit(","), F.lit("")).rlike(r"\A-?[0-9]+(?:\.[0-9]+)?\n?\z")


def spans(text: Column, start: str, end: str) -> Column:
    """Contents between two markers, shortest first (FN-22)."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)\Q{start}\E(.*?)\Q{end}\E"), F.lit(1))


def removed_share(text: Column, *words: str) -> Column:
    """Share of the characters that go when these strings are deleted (FN-23)."""
    left = text
    for w in words:
        left = F.replace(left, F.lit(w), F.lit(""))
    n = F.char_length(text)
    return F.when(n > 0, (n - F.char_length(left)) / n).otherwise(F.lit(0.0))


def patch_newline(patch: Column) -> Column:
    """Exactly one line feed at the end of a patch (FN-08)."""
    return F.concat(F.regexp_replace(patch, r"[\r\n]+\z", ""), F.lit("\n"))


def truncated(text: Column, limit: int) -> Column:
    """A bounded text with what was cut (FN-30)."""
    return F.struct(F.left(text, F.lit(limit)).alias("text"), (F.char_length(text) > limit).alias("truncated"), F.char_length(text).cast("long").alias("original_length"))


def inside_root(path: Column) -> Column:
    """Whether a relative path stays under its root (FN-12): never absolute,
    and at no segment more steps up than down."""
    step = lambda s: F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))
    walked = F.aggregate(F.split(path, "/"), start, lambda a, s: F.struct((a["depth"] + step(s)).alias("depth"), (a["ok"] & (a["depth"] + step(s) >= 0)).alias("ok")))
    return walked["ok"] & ~path.startswith("/")


#: Rules for credentials and personal data (FN-29), plain enough for any
#: regular expression engine.
LEAK_RULES = {
    "credential": r"(?i)(secret|password|api_key|token|credential)",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "long_number": r"[0-9]{13,19}",
    "phone": r"\+[0-9][0-9 ().-]{6,18}[0-9]",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "cloud_key": r"(AKIA|ASIA)[0-9A-Z]{16}",
    "forge_token": r"gh[pousr]_[A-Za-z0-9]{36}",
    "web_token": r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "url_credential": r"[a-z][a-z0-9+.-]*://[^/ :@]+:[^/ :@]+@",
    "long_hex": r"[0-9a-f]{32}",
}


def leaks(text: Column) -> Column:
    """Names of the rules that a text breaks, in the table's order."""
    return F.array_compact(F.array(*[F.when(text.rlike(rule), F.lit(name)) for name, rule in LEAK_RULES.items()]))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once: as a lambda's variable it is
    not copied into inner lambdas, where it would be computed for each of
    their elements."""
    return F.transform(F.array(value), use)[0]


def word_windows(text: Column, n: int) -> Column:
    """64-bit hashes of the runs of n words of the normalised text, from the
    hashes of the words, so that no run is built as a text; fewer words give
    none."""
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
    hashes = F.transform(F.split(normalised(text), " "), lambda w: F.xxhash64(w))
    return bound(hashes, lambda h: F.when(F.size(h) >= n, runs(h)).otherwise(F.array().cast("array<bigint>")))


#: A JSON string, possessively: it never ends at an escaped quote.
_STRING = r'"(?:[^"\\]|\\.)*+"'


def canonical_json(text: Column) -> Column:
    """One text for equal JSON values, whatever their types and depth: members
    by name, no white space, null members left out at every depth, null
    elements of lists kept (FN-01/02).  Text that is no JSON gives null.

    The value goes through VARIANT, which sorts members and keeps numbers,
    booleans and nested values as they are; strings are stepped over whole, so
    nothing inside them is taken for a member.
    """
    sorted_ = F.to_json(F.try_parse_json(text))
    kept = F.regexp_replace(sorted_, rf"({_STRING}(?!:null\b))|{_STRING}:null,?", "$1")
    return F.regexp_replace(kept, rf"({_STRING})|,(?=\}})", "$1")
