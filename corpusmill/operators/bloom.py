"""Bloom filters of 64-bit hashes, built by aggregation and probed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each value, of which three are set, and most bits of a filter that
#: is broadcast (1 MB).  With 12 bits about one value in a hundred passes that
#: is not in it.
BITS, MOST = 12, 1 << 23


def _places(g: Column, size: int) -> list[Column]:
    """Three places of a hash, from different parts of it."""
    return [F.call_function("shiftrightunsigned", g, F.lit(k)).bitwiseAND(F.lit(size - 1)) for k in (0, 20, 41)]


def bloom(values: DataFrame, column: str, most: int = MOST) -> tuple[DataFrame, int] | None:
    """One row (bits array<long>) and its size in bits, or None if so many
    values would need more than `most` bits: then there is no filter, and the
    caller's join is as it was.  Words of bits are combined where the values
    are, so what is shuffled and what the driver puts together is at most the
    filter itself."""
    n = values.count()
    size = 1 << max(10, (max(n, 1) * BITS - 1).bit_length())
    if size > most:
        return None
    place = F.explode(F.array(*_places(F.col(column), size)))
    words = values.select(place.alias("p")).groupBy((F.shiftright("p", 6)).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    bits = [0] * (size // 64)
    for r in words.collect():  # size / 64 rows at most
        bits[r["w"]] = r["b"]
    return values.sparkSession.createDataFrame([(bits,)], "bits array<long>"), size


def passes(g: Column, bits: Column, size: int) -> Column:
    """Whether a value may be in the filter; never false for one that is."""
    on = lambda p: F.call_function("shiftright", F.get(bits, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    a, b, c = (on(p) for p in _places(g, size))
    return a & b & c
