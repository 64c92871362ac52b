"""Rules that judge rows: rejection reasons, missing facts, first divergence
and episode metrics, over columns that the caller names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons to reject a demonstration, in the order in which they are listed
#: (CMP-20).
REASONS = ["patch_does_not_apply", "required_tests_fail", "edits_out_of_scope", "calls_do_not_round_trip", "leaked_data", "verification_cheated", "truncated", "too_long"]
#: Reasons of a final result that failed although the row itself is sound.
FAILED_FINALS = ["patch_does_not_apply", "required_tests_fail"]


def _set(flags: dict[str, Column], order: list[str]) -> Column:
    if unknown := set(flags) - set(order):
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    return F.array_compact(F.array(*[F.when(flags[k], k) for k in order if k in flags]))


def rejection(flags: dict[str, Column]) -> Column:
    """(reasons, lane): every reason that holds, and where the row goes: `sft`
    without one, `preference` if its final result alone failed, else `reject`."""
    reasons = _set(flags, REASONS)
    lane = lambda r: F.when(F.size(r) == 0, "sft").when(F.size(F.array_except(r, F.array(*map(F.lit, FAILED_FINALS)))) == 0, "preference").otherwise("reject")
    return F.transform(F.array(reasons), lambda r: F.struct(r.alias("reasons"), lane(r).alias("lane")))[0]


#: What must be recorded of a source (CMP-33) and of a released artefact
#: (CMP-34).
SOURCE_FACTS = ["revision", "licence", "provenance", "overlap_risk", "tests_executed", "schema_and_format", "transformations"]
RELEASE_FACTS = ["parent_and_lineage", "commits", "type_and_bits", "calibration", "template_hash", "evaluation", "runtime_settings", "limitations"]


def missing(facts: dict[str, Column], wanted: list[str]) -> Column:
    """Facts that are not given, null or blank, in the order wanted."""
    lacks = lambda k: facts[k].isNull() | (F.trim(facts[k].cast("string")) == "") if k in facts else F.lit(True)
    return F.array_compact(F.array(*[F.when(lacks(k), k) for k in wanted]))


#: Categories of the first action in which a candidate and its parent differ,
#: in order of precedence (CMP-30).
DIVERGENCE = ["template_incompatible", "premature_completion", "loop", "invalid_tool", "corrupted_arguments", "incorrect_token", "lost_fact", "different_plan"]


def divergence(flags: dict[str, Column], both_succeed: Column) -> Column:
    """The first category that holds; plans that differ count as such only
    where both succeed, and a difference that nothing explains is a lost
    fact."""
    chosen = F.when(both_succeed, "different_plan")
    for k in DIVERGENCE:
        if k in flags:
            chosen = chosen.when(flags[k], k)
    return chosen.otherwise("lost_fact")


def episode_rates(episodes: DataFrame, *by: str) -> DataFrame:
    """One row for each group of episodes (MET-01 to MET-12 but recovery and
    loops, which are counted before): ratios of sums, null without a
    denominator.

    Episodes have hidden, claimed, verified (boolean), visible_passed,
    visible_total, calls, valid, executed, relevant_lines, total_lines,
    tokens, seconds, failures, recovered, loops.
    """
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    wins = F.count_if("hidden")
    return episodes.groupBy(*by).agg(
        F.count("*").alias("episodes"),
        share(wins, F.count("*")).alias("success"),
        share(F.sum("visible_passed"), F.sum("visible_total")).alias("visible_fraction"),
        share(F.sum("valid"), F.sum("calls")).alias("valid_calls"),
        share(F.sum("executed"), F.sum("valid")).alias("argument_success"),
        share(F.sum("recovered"), F.sum("failures")).alias("recovery"),
        share(F.count_if(F.col("claimed") & ~F.col("verified")), F.count("*")).alias("unsupported_claims"),
        share(F.sum("relevant_lines"), F.sum("total_lines")).alias("patch_precision"),
        share(F.sum("calls"), wins).alias("calls_per_success"),
        share(F.sum("tokens"), wins).alias("tokens_per_success"),
        share(F.sum("seconds"), wins).alias("seconds_per_success"),
        share(F.sum("loops"), F.sum("calls")).alias("loop_rate"),
    )


def excluded(rows: DataFrame, family: str, evaluation: DataFrame) -> DataFrame:
    """The rows whose family is none of the evaluation's (column `family`),
    by an anti join (JON-10, CMP-26)."""
    held = evaluation.select(F.col("family").alias("_held")).where("_held is not null").distinct()
    return rows.join(held, rows[family] == held["_held"], "left_anti")
