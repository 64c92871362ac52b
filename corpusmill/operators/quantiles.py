"""Exact quantiles by selection: approximate ones fence in the wanted ranks,
and only what lies between the fences is put in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import forget, stored

#: Groups whose fences may be broadcast.
BROADCAST_GROUPS = 100_000


def quantiles(rows: DataFrame, value: Column, shares: Sequence[float], by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """(by..., n, q0, q1, ...): of each group the number of values and their
    quantiles by linear interpolation between neighbours, as doubles.

    1. A bounded sketch gives two values around every wanted rank.
    2. A pass counts what lies below and up to them, which shows whether they
       do hold the rank; fences that do not are set wider.
    3. The values between the fences, about 4 / accuracy of a group, are added
       up by value and put in order, and the two neighbours of the rank read.

    So no task keeps or orders a group, however large or diverse it is.  Nulls
    and NaN count for nothing; a group without values has no row; a null group
    is a group.
    """
    keys = [f"_k{i}" for i in range(max(len(by), 1))]
    group = [F.col(c).alias(k) for c, k in zip(by, keys, strict=False)] if by else [F.lit(0).alias(keys[0])]
    x = stored(rows.select(*group, value.cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x")))
    width = 2 / accuracy
    same = lambda other: [F.col(k).eqNullSafe(other[f"{k}_"]) for k in keys]
    places = range(len(shares))
    while True:
        probes = [p for s in shares for p in (max(s - width, 0.0), min(s + width, 1.0))]
        fences = stored(x.groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(F.count("*").alias("_n"), F.percentile_approx("_x", probes, accuracy).alias("_b")))
        small = fences.count() <= BROADCAST_GROUPS
        inside = x.join(F.broadcast(fences) if small else fences, same(fences))
        low, high = (lambda j: F.col("_b")[2 * j]), (lambda j: F.col("_b")[2 * j + 1])
        counts = [c for j in places for c in (F.count_if(F.col("_x") < low(j)).alias(f"_l{j}"), F.count_if(F.col("_x") <= high(j)).alias(f"_u{j}"))]
        counted = stored(inside.groupBy(*[f"{k}_" for k in keys]).agg(F.first("_n").alias("_n"), *counts))
        rank = lambda j: F.lit(float(shares[j])) * (F.col("_n") - 1)
        held = [(F.col(f"_l{j}") <= F.floor(rank(j))) & (F.ceil(rank(j)) < F.col(f"_u{j}")) for j in places]
        outside = counted.where(~F.forall(F.array(*held), lambda h: h)).limit(1).count()
        if not outside or width >= 1:
            break
        forget(fences, counted)
        width *= 8
    between = F.filter(F.array(*[F.when((F.col("_x") >= low(j)) & (F.col("_x") <= high(j)), j) for j in places]), lambda j: j.isNotNull())
    values = inside.select(*[f"{k}_" for k in keys], "_x", F.explode(between).alias("_j")).groupBy(*[f"{k}_" for k in keys], "_j", "_x").agg(F.count("*").alias("_c"))
    end = F.sum("_c").over(Window.partitionBy(*[f"{k}_" for k in keys], "_j").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    placed = values.withColumn("_end", end).join(F.broadcast(counted.withColumnsRenamed({f"{k}_": k for k in keys})) if small else counted.withColumnsRenamed({f"{k}_": k for k in keys}), [F.col(f"{k}_").eqNullSafe(F.col(k)) for k in keys])
    below = F.get(F.array(*[F.col(f"_l{j}") for j in places]), F.col("_j"))
    r = F.get(F.array(*[rank(j) for j in places]), F.col("_j"))
    holds = lambda at: (below + F.col("_end") - F.col("_c") <= at) & (at < below + F.col("_end"))
    found = placed.groupBy(*keys, "_j").agg(F.first("_n").alias("_n"), F.max(F.when(holds(F.floor(r)), F.col("_x"))).alias("_v"), F.max(F.when(holds(F.ceil(r)), F.col("_x"))).alias("_w"), F.max(r - F.floor(r)).alias("_f"))
    one = F.when((F.col("_f") == 0) | (F.col("_v") == F.col("_w")), F.col("_v")).otherwise(F.col("_v") + F.col("_f") * (F.col("_w") - F.col("_v")))
    out = found.groupBy(*keys).agg(F.first("_n").alias("n"), *[F.max(F.when(F.col("_j") == j, one)).alias(f"q{j}") for j in places])
    return out.withColumnsRenamed(dict(zip(keys, by, strict=False))) if by else out.drop(keys[0])
