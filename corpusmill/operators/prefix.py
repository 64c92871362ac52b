"""Running sums over a whole order, by ranges: no task orders all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def _ranged(rows: DataFrame, keys: list[str], size: str) -> DataFrame:
    # stored, so that a row's range is the same whenever it is looked at
    few = rows.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], F.col(size).cast("long").alias("_size"))
    return stored(few.repartitionByRange(*[f"_o{i}" for i in range(len(keys))]).withColumn("_part", F.spark_partition_id()))


def running_sum(rows: DataFrame, keys: list[str], size: str, total: str = "total") -> DataFrame:
    """(keys..., size, total): the sum of all sizes up to and with each row,
    in the order of the keys; equal keys count one after the other, and a null
    size adds nothing.

    Only keys and sizes move: they are dealt to ranges, the ranges' sums (one
    row a range) are added up first, and each range is summed on its own.
    """
    order = [f"_o{i}" for i in range(len(keys))]
    parts = _ranged(rows, keys, size)
    sums = parts.groupBy("_part").agg(F.sum(F.coalesce("_size", F.lit(0))).alias("_s"))
    before = sums.select("_part", F.coalesce(F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_size").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    out = parts.withColumn("_inside", inside).join(F.broadcast(before), "_part")  # a row a range
    return out.select(*[F.col(o).alias(k) for o, k in zip(order, keys, strict=True)], F.col("_size").alias(size), (F.col("_inside") + F.col("_before")).alias(total))


def last_within(rows: DataFrame, key: str, size: str, budget: int) -> tuple[object, bool]:
    """The largest key up to which the sizes add up to the budget at most,
    None if the first is over, and whether any row is left.  Keys must differ.
    Only the range in which the budget runs out is put in order."""
    parts = _ranged(rows, [key], size)
    left, last = budget, None
    for r in parts.groupBy("_part").agg(F.sum(F.coalesce("_size", F.lit(0))).alias("s"), F.max("_o0").alias("last")).orderBy("_part").collect():  # a row a range
        if r["s"] > left:
            total = F.sum(F.coalesce("_size", F.lit(0))).over(Window.partitionBy("_part").orderBy("_o0").rowsBetween(Window.unboundedPreceding, 0))
            here = parts.where(F.col("_part") == r["_part"]).withColumn("_total", total).where(F.col("_total") <= left).agg(F.max("_o0")).first()[0]
            return (last if here is None else here), True
        left, last = left - r["s"], r["last"]
    return last, False
