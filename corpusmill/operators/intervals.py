"""Paired comparisons of rates: a bootstrap whose weights come from hashes,
clustered by task, and the exact test of McNemar."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits of a hash that make a number between 0 and 1, exact in a double.
DIGITS = 13
#: Where the distribution function of Poisson's law of mean 1 steps up.
STEPS = [math.fsum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


def poisson_weight(key: Column, replicate: Column) -> Column:
    """How often a key is drawn in a replicate: a Poisson variable of mean 1
    by inversion of a hash, so every task on every machine draws the same."""
    h = F.md5(F.concat(key.cast("string"), F.lit(":"), replicate.cast("string")))
    u = F.conv(F.left(h, F.lit(DIGITS)), 16, 10).cast("long") / F.lit(float(16**DIGITS))
    return sum(((u >= s).cast("int") for s in STEPS), F.lit(0))


def paired_bootstrap(pairs: DataFrame, cluster: str, measures: dict[str, tuple[str, str]], sides: tuple[str, str] = ("parent", "candidate"), replicates: int = 200, level: float = 0.95) -> DataFrame:
    """(measure, parent, candidate, delta, low, high, clusters): each rate on
    both sides, their difference and its percentile interval.

    pairs: a row for each task and seed that both sides have, structs named
    like the sides with the columns that measures name, (numerator,
    denominator).  Clusters are added up first, so what is replicated is a row
    a cluster and measure; each is weighted the same on both sides and in all
    measures of a replicate.  The weighted sums are partial: what is shuffled
    is a row a task, measure and replicate.  A replicate without a denominator
    says nothing; a null counts as 0.
    """
    a, b = sides
    value = lambda side, column: F.coalesce(F.col(f"{side}.{column}").cast("double"), F.lit(0.0))
    flat = F.array(*[F.struct(F.lit(m).alias("measure"), value(a, x).alias("an"), value(a, y).alias("ad"), value(b, x).alias("bn"), value(b, y).alias("bd")) for m, (x, y) in measures.items()])
    sums = ("an", "ad", "bn", "bd")
    tasks = pairs.select(F.col(cluster).alias("_c"), F.explode(flat).alias("x")).groupBy("_c", "x.measure").agg(*[F.sum(f"x.{s}").alias(s) for s in sums])
    rate = lambda side: F.col(f"{side}n") / F.nullif(F.col(f"{side}d"), F.lit(0.0))
    whole = tasks.groupBy("measure").agg(*[F.sum(s).alias(s) for s in sums], F.count("*").alias("clusters")).select("measure", rate("a").alias(a), rate("b").alias(b), (rate("b") - rate("a")).alias("delta"), "clusters")
    drawn = tasks.select("measure", "_c", *sums, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_r")).withColumn("_w", poisson_weight(F.col("_c"), F.col("_r")))
    again = drawn.groupBy("measure", "_r").agg(*[F.sum(F.col("_w") * F.col(s)).alias(s) for s in sums]).select("measure", (rate("b") - rate("a")).alias("d"))
    tail = (1 - level) / 2
    bounds = again.groupBy("measure").agg(F.percentile("d", F.array(F.lit(tail), F.lit(1 - tail))).alias("p"))  # `replicates` values each
    return whole.join(bounds, "measure").select("measure", a, b, "delta", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "clusters")


def mcnemar(lost: Column, gained: Column) -> Column:
    """The exact two-sided probability of so uneven a division of the pairs
    that differ, if either way is as likely: twice the binomial tail, at most
    1.  Sums run down from the largest term, in logarithms, so many pairs do
    not underflow."""
    n, m = (lost + gained).cast("long"), F.least(lost, gained).cast("long")
    upto = F.when(m > 0, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<bigint>"))
    top = F.aggregate(upto, F.lit(0.0), lambda s, k: s + F.log((n - k + 1) / k)) - n * math.log(2)
    # each term below the largest, as a share of it
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    down = F.aggregate(F.reverse(upto), state, lambda s, k: F.struct((s["term"] * k / (n - k + 1)).alias("term"), (s["sum"] + s["term"] * k / (n - k + 1)).alias("sum")))["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(top + F.log(down))))
