"""Candidate against parent, with what chance alone would give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as I
from .episodes import EPISODES, episodes
from .registry import query

REPLICATES = 200
MEASURES = {"success": ("won", "one"), "visible_fraction": ("visible_passed", "visible_total"), "valid_calls": ("valid", "calls"), "recovery": ("recovered", "failures"), "loop_rate": ("loops", "calls"), "seconds_per_call": ("seconds", "calls")}


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, seed, parent, candidate): what both made of the same task and
    seed."""
    e = episodes(spark, sf_dir).withColumns({"won": F.col("hidden").cast("int"), "one": F.lit(1)})
    columns = sorted({c for m in MEASURES.values() for c in m} | {"hidden"})
    side = lambda n, name: e.where(F.col("side") == n).select("task", "seed", F.struct(*columns).alias(name))
    return side(0, "parent").join(side(1, "candidate"), ["task", "seed"])


_BOTH = "b AS (SELECT p.task, p.seed, p AS p, c AS c FROM (SELECT *, hidden::INT AS won, 1 AS one FROM e) p JOIN (SELECT *, hidden::INT AS won, 1 AS one FROM e) c ON p.task = c.task AND p.seed = c.seed AND p.side = 0 AND c.side = 1)"
_FLAT = " UNION ALL ".join(f"SELECT task, '{m}' AS measure, sum(p.{x})::DOUBLE AS an, sum(p.{y})::DOUBLE AS ad, sum(c.{x})::DOUBLE AS bn, sum(c.{y})::DOUBLE AS bd FROM b GROUP BY task" for m, (x, y) in MEASURES.items())
_WEIGHT = " + ".join(f"(u >= {s!r}::DOUBLE)::INT" for s in I.STEPS)
_RATE = "sum({w}bn) / nullif(sum({w}bd), 0) - sum({w}an) / nullif(sum({w}ad), 0)"


@query(
    f"""WITH {EPISODES}, {_BOTH}, t AS MATERIALIZED ({_FLAT}),
    u AS (SELECT task, r, ('0x' || left(md5(task || ':' || r), {I.DIGITS}))::BIGINT / {float(16**I.DIGITS)!r}::DOUBLE AS u FROM (SELECT DISTINCT task FROM b), range({REPLICATES}) x(r)), w AS (SELECT task, r, {_WEIGHT} AS w FROM u),
    dd AS (SELECT measure, r, {_RATE.format(w='w * ')} AS d FROM t JOIN w USING (task) GROUP BY measure, r),
    q AS (SELECT measure, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM dd GROUP BY measure)
    SELECT measure, round(sum(an) / nullif(sum(ad), 0), 6) AS parent, round(sum(bn) / nullif(sum(bd), 0), 6) AS candidate, round({_RATE.format(w='')}, 6) AS delta, any_value(low) AS low, any_value(high) AS high, count(*) AS clusters FROM t JOIN q USING (measure) GROUP BY measure"""
)
def met_paired_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-09, MET-01 to MET-12: the difference of six rates between candidate
    and parent on the same tasks and seeds, with intervals that take a task's
    seeds together."""
    found = I.paired_bootstrap(pairs(spark, sf_dir), "task", MEASURES, replicates=REPLICATES)
    return found.select("measure", *[F.round(c, 6).alias(c) for c in ("parent", "candidate", "delta", "low", "high")], "clusters")


@query(
    f"""WITH {EPISODES}, {_BOTH}, n AS (SELECT count(*) AS pairs, count(*) FILTER (p.hidden AND c.hidden) AS both_ok, count(*) FILTER (p.hidden AND NOT c.hidden) AS lost, count(*) FILTER (c.hidden AND NOT p.hidden) AS gained FROM b)
    SELECT *, round(CASE WHEN lost + gained = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(lost + gained + 1) - lgamma(k + 1) - lgamma(lost + gained - k + 1) - (lost + gained) * ln(2.0))) FROM range(least(lost, gained) + 1) x(k))) END, 6) AS p_value FROM n"""
)
def met_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-09: pairs that only one side solves, and how likely so uneven a
    division is by chance."""
    p, c = F.col("parent.hidden"), F.col("candidate.hidden")
    n = pairs(spark, sf_dir).agg(F.count("*").alias("pairs"), F.count_if(p & c).alias("both_ok"), F.count_if(p & ~c).alias("lost"), F.count_if(c & ~p).alias("gained"))
    return n.withColumn("p_value", F.round(I.mcnemar(F.col("lost"), F.col("gained")), 6))
