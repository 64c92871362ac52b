"""Contracts for functions that a caller brings: over a row's columns, over
batches, and rewards that are summed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Row = Callable[[str], Column]


def map_rows(rows: DataFrame, f: Callable[[Row], dict[str, Column]], drop: bool = False) -> DataFrame:
    """The rows with the columns that f makes of a row; with drop, only those
    (UDF-01).  f gets a row as a function from name to column and runs in the
    JVM."""
    made = f(lambda name: F.col(name))
    return rows.select(*[c.alias(k) for k, c in made.items()]) if drop else rows.withColumns(made)


def filter_rows(rows: DataFrame, f: Callable[[Row], Column]) -> DataFrame:
    """The rows for which f holds (UDF-01)."""
    return rows.where(f(lambda name: F.col(name)))


def map_batches(rows: DataFrame, columns: list[str], f: Callable[..., pa.Array], name: str, kind: str) -> DataFrame:
    """The rows with one more column, which f makes of whole Arrow columns
    (UDF-02): for what has no Spark expression.  f sees a batch at a time and
    must not look from one row to another."""
    inner = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, f(*[b.column(inner.index(c)) for c in columns])], names=[*inner, name])

    return rows.mapInArrow(run, rows.withColumn(name, F.lit(None).cast(kind)).schema)
