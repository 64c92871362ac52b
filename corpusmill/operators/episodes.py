"""Episodes from a log of turns: termination, usage, bands and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def account(turns: DataFrame, episode: list[str], order: str, calls: Column, seconds: Column, max_calls: int = 10, timeout: float = 480.0) -> DataFrame:
    """How each episode ends and what it used (CMP-06).

    A turn starts only while the time before it is within the timeout; a turn
    whose calls would go over the budget is dropped whole and ends the
    episode; a turn without calls is the final answer.
    """
    w = Window.partitionBy(*episode).orderBy(order)
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumns({"_calls": calls, "_seconds": seconds})
    rows = rows.withColumns({"_late": F.coalesce(F.sum("_seconds").over(before), F.lit(0.0)) > timeout, "_over": F.sum("_calls").over(so_far) > max_calls})
    rows = rows.withColumn("_stop", F.when(F.col("_late"), "timeout").when(F.col("_calls") == 0, "assistant_complete").when(F.col("_over"), "tool_budget"))
    rows = rows.withColumn("_stopped", F.coalesce(F.max(F.col("_stop").isNotNull().cast("int")).over(before), F.lit(0)))
    live = rows.where("_stopped = 0")
    counted = F.col("_stop").isNull() | (F.col("_stop") == "assistant_complete")
    return live.groupBy(*episode).agg(
        F.coalesce(F.max("_stop"), F.lit("tool_budget")).alias("termination"),
        F.coalesce(F.sum(F.when(counted, F.col("_calls"))), F.lit(0)).cast("long").alias("tool_calls"),
        F.round(F.coalesce(F.sum(F.when(F.col("_stop").isNull() | (F.col("_stop") != "timeout"), F.col("_seconds"))), F.lit(0.0)), 3).alias("wall_seconds"),
        F.count_if(counted).alias("turns"),
    )


def horizon(calls: Column) -> Column:
    """Bands of tool calls; an episode without calls has none (CMP-23)."""
    return F.when(calls < 1, "none").when(calls <= 5, "1-5").when(calls <= 15, "6-15").when(calls <= 30, "16-30").otherwise("31+")


def difficulty(rate: Column) -> Column:
    """Bands of success rates; between 80 and 90 per cent none is defined
    (CMP-22)."""
    return F.when(rate > 0.9, "trivial").when(rate.between(0.2, 0.8), "learnable").when(rate < 0.2, "frontier").otherwise("unassigned")


def context_band(tokens: Column) -> Column:
    """Context phases by token count (CMP-23/24)."""
    return F.when(tokens <= 4096, "4096").when(tokens <= 8192, "8192").when(tokens <= 16384, "16384").otherwise("32K+")


#: Outcomes in order of precedence; infrastructure comes first, so that it is
#: never counted against the model (CMP-29).
OUTCOMES = ["infrastructure", "invalid_json", "unknown_tool", "tool_failure", "loop", "truncated", "budget", "patch_failed", "build_failed", "visible_regression", "hidden_failure", "correct"]


def outcome(flags: dict[str, Column]) -> Column:
    """The first outcome whose flag is set, `correct` if none is."""
    chosen = None
    for name in OUTCOMES:
        if name in flags:
            chosen = F.when(flags[name], name) if chosen is None else chosen.when(flags[name], name)
    return F.lit("correct") if chosen is None else chosen.otherwise("correct")


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval of a rate."""
    p = successes / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)
