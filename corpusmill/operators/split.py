"""Splits by group without leakage, samples and hold-outs, all by hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validation_count(n: Column, share: float = 0.10) -> Column:
    """Families that go to validation: half-even rounded share, at least one
    and not all (WIN-02)."""
    return F.least(F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("long")), n - 1)


def smallest_hash_cut(hashes: DataFrame, k: int, digits: int = 3) -> str:
    """The k-th smallest of different hexadecimal hashes (a column `h`), found
    without sorting them all: counts by their first digits, 4,096 rows at
    most, say in which part it lies, and only that part is ordered."""
    prefix = F.left("h", F.lit(digits))
    before = 0
    for r in hashes.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        if before + r["n"] >= k:
            return hashes.where(prefix == r["p"]).orderBy("h").limit(k - before).agg(F.max("h")).first()[0]
        before += r["n"]
    raise ValueError(f"fewer than {k} hashes")


def family_split(rows: DataFrame, family: str, share: float = 0.10) -> DataFrame:
    """The rows with `split`: families in the order of their names' sha256,
    the first ones for validation (CMP-03, WIN-01).

    The families are counted by a part of their hash and the hash up to which
    they validate is looked up, so no task orders all of them; rows are
    compared with it where they are, without a join.  Rows without a family
    are one family of their own, whose hash is that of nothing.  Fewer than
    two families cannot be split.
    """
    h = F.sha2(F.coalesce(F.col(family).cast("string"), F.lit("")), 256)
    families = rows.select(h.alias("h")).distinct()
    n = families.count()
    if n < 2:
        raise ValueError(f"a split needs two families, found {n}")
    k = rows.sparkSession.range(1).select(validation_count(F.lit(n), share)).first()[0]
    return rows.withColumn("split", F.when(h <= smallest_hash_cut(families, k), "validation").otherwise("train"))


def seeded_split(rows: DataFrame, key: str, seed: str, small: int = 20) -> DataFrame:
    """The rows with `split` by row, by the hash of seed and key: a tenth for
    test, and half of a table of fewer than `small` rows (WIN-08)."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), F.lit(8)), 16, 10).cast("long")
    share = 0.5 if rows.limit(small).count() < small else 0.1
    return rows.withColumn("split", F.when(h < int(share * (1 << 32)), "test").otherwise("train"))


def newest_held_out(rows: DataFrame, at: str, share: float = 0.10) -> DataFrame:
    """The rows with `held_out`: at or after the time that the older ones, all
    but `share`, reach (WIN-10).

    Counts by day say on which day it lies, and only that day is ordered.
    Rows without a time are not held out; without any time none is.
    """
    times = rows.where(F.col(at).isNotNull()).select(F.col(at).alias("t"), F.to_date(at).alias("d"))
    days = times.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect()  # one row a day
    left, cut = math.ceil(round((1 - share) * sum(r["n"] for r in days), 6)), None
    for r in days:
        if left <= r["n"]:
            cut = times.where(F.col("d") == F.lit(r["d"])).orderBy("t").limit(max(left, 1)).agg(F.max("t")).first()[0]
            break
        left -= r["n"]
    return rows.withColumn("held_out", F.lit(False) if cut is None else F.coalesce(F.col(at) >= F.lit(cut), F.lit(False)))


def within_budget(rows: DataFrame, group: str, key: str, size: str, digits: int = 3) -> DataFrame:
    """The rows with `total`: the running sum of sizes in each group in the
    order of the key's md5 and the key (CMP-25).

    Sums by a part of the hash, 4,096 rows a group at most, are added up
    first, so a task orders one part of a group and never all of it.
    """
    h = F.md5(F.col(key).cast("string"))
    parts = rows.withColumns({"_h": h, "_part": F.left(h, F.lit(digits))})
    sums = parts.groupBy(group, "_part").agg(F.sum(size).alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.sum(size).over(Window.partitionBy(group, "_part").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_inside", inside).join(before, [group, "_part"]).withColumn("total", F.col("_inside") + F.col("_before")).drop("_h", "_part", "_inside", "_before")


def hashed_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: str = "") -> DataFrame:
    """n rows of each stratum, by md5 of seed and key (WIN-07/09)."""
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))).where(F.col("_r") <= n).drop("_r")
