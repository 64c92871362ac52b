"""Rewards as columns; a total is their sum, so any of them can be combined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def toy(visible: Column, ran: Column, hidden: Column, tool_errors: Column, digest: Column, expected: Column, errored: Column) -> Column:
    """Hidden tests dominate; changed tests or an error are worth nothing
    (CMP-09)."""
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    score = 0.2 * one(visible & ran) + 0.8 * one(hidden) - 0.05 * tool_errors
    return F.when(F.coalesce(digest != expected, F.lit(True)) | errored, 0.0).otherwise(F.greatest(F.lit(0.0), score))


#: Weights of the named reward vector; penalties are subtracted.
WEIGHTS = {"hidden_test_fraction": 0.55, "visible_test_fraction": 0.25, "build_validity": 0.10, "valid_tool_protocol": 0.05, "bounded_efficiency": 0.05}
PENALTIES = ("regression_penalty", "scope_penalty", "safety_penalty")


def scalar(vector: Callable[[str], Column]) -> Column:
    """The vector as one number (CMP-10)."""
    gain = sum((w * vector(k) for k, w in WEIGHTS.items()), F.lit(0.0))
    return gain - sum((vector(k) for k in PENALTIES), F.lit(0.0))


def channel_format(text: Column) -> Column:
    """A reply, and reasoning before it (CMP-11)."""
    reasoning, reply = T.split_channels(text)
    return F.when(reply != "", 1.0).otherwise(-1.0) + F.when(reasoning != "", 0.5).otherwise(0.0)


def number_format(text: Column) -> Column:
    """One bare number best, a number among words little (CMP-12)."""
    reply = F.replace(T.split_channels(text)[1], F.lit(","), F.lit(""))
    found = T.numbers(reply)
    return F.when((F.size(found) == 1) & (T.strip(reply) == found[0]), 1.0).when(F.size(found) >= 1, 0.25).otherwise(-0.5)


def number_correct(text: Column, gold: Column) -> Column:
    """The last number of the reply against the answer (CMP-13)."""
    found = T.numbers(F.replace(T.split_channels(text)[1], F.lit(","), F.lit("")))
    got = F.when(F.size(found) > 0, F.element_at(found, -1)).try_cast("double")
    return F.when(F.abs(got - gold.try_cast("double")) < 1e-6, 4.0).otherwise(-0.5)


#: Markers of delimited completions.
REASONING, SOLUTION = ("<REASONING>", "</REASONING>"), ("<SOLUTION>", "</SOLUTION>")


def span_format(text: Column) -> Column:
    """Exactly one span of each kind, and no gibberish (CMP-14)."""
    one = lambda m: F.when(F.size(T.spans(text, *m)) == 1, 1.0).otherwise(0.0)
    return one(REASONING) + one(SOLUTION) - F.when(T.removed_share(text, "addCriterion", "\n") >= 0.5, 2.0).otherwise(0.0)


def span_correct(text: Column, answer: Column) -> Column:
    """The only solution span equals the answer but for line feeds (CMP-15)."""
    found = T.spans(text, *SOLUTION)
    return F.when((F.size(found) == 1) & (F.replace(F.when(F.size(found) > 0, found[0]), F.lit("\n"), F.lit("")) == answer), 2.0).otherwise(0.0)


#: Rewards by name: functions of a completion and of a row's columns (UDF-03).
Reward = Callable[[Column, Callable[[str], Column]], Column]
REWARDS: dict[str, Reward] = {
    "channel_format": lambda text, row: channel_format(text),
    "number_format": lambda text, row: number_format(text),
    "number_correct": lambda text, row: number_correct(text, row("gold")),
    "span_format": lambda text, row: span_format(text),
    "span_correct": lambda text, row: span_correct(text, row("answer")),
}


def total(names: list[str], text: Column, row: Callable[[str], Column], rewards: dict[str, Reward] | None = None) -> Column:
    """The sum of the named rewards; one that gives nothing is worth 0
    (CMP-16)."""
    known = REWARDS if rewards is None else rewards
    if unknown := set(names) - set(known):
        raise ValueError(f"unknown rewards: {sorted(unknown)}")
    return sum((F.coalesce(known[n](text, row).cast("double"), F.lit(0.0)) for n in names), F.lit(0.0))
