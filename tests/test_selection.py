"""Quantiles by selection and running sums by ranges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators.prefix import last_within, running_sum
from corpusmill.operators.quantiles import quantiles

SHARES = (0.0, 0.01, 0.5, 0.9, 0.999, 1.0)


def values():
    rng = np.random.default_rng(3)
    return {
        "skewed": (2.0 ** rng.uniform(-900, 900, 3000)).tolist(),
        "ties": rng.integers(0, 4, 3000).astype(float).tolist(),
        "hot": [7.0] * 2900 + [float(k) for k in range(100)],
        "one": [3.5],
        "two": [1.0, 2.0],
        "odd": [None, float("nan"), -0.0, 5.0, float("-inf")],
        None: rng.normal(size=2000).tolist(),
        "nothing": [None, float("nan")],
    }


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_quantiles_equal_numpy(spark, accuracy):
    rows = [(g, v) for g, xs in values().items() for v in xs]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    found = {r["g"]: r for r in quantiles(df, F.col("x"), SHARES, ["g"], accuracy).collect()}
    assert set(found) == set(values()) - {"nothing"}
    for g, r in found.items():
        xs = [x for x in values()[g] if x is not None and not math.isnan(x)]
        assert r["n"] == len(xs)
        if g != "odd":
            assert [r[f"q{i}"] for i in range(len(SHARES))] == pytest.approx(np.quantile(xs, SHARES).tolist(), rel=1e-12)
    assert (found["odd"]["q0"], found["odd"]["q5"]) == (float("-inf"), 5.0)


def test_quantiles_without_groups_and_without_rows(spark):
    df = spark.range(1, 101).select(F.col("id").alias("_x"))
    assert quantiles(df, F.col("_x") * 2, [0.5, 0.25]).first().asDict() == {"n": 100, "q0": 101.0, "q1": 51.5}
    assert quantiles(df.limit(0), F.col("_x"), [0.5]).collect() == []


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(f"p{k % 300:03}", k, int(rng.integers(0, 50)) if k % 9 else None) for k in range(600)]
    df = spark.createDataFrame(rows, "path string, n long, size long").repartition(5)
    expected, total = [], 0
    for path, n, size in sorted(rows):
        total += size or 0
        expected.append((path, n, size, total))
    assert sorted(map(tuple, running_sum(df, ["path", "n"], "size").collect())) == expected


@pytest.mark.parametrize("budget", [-1, 0, 5, 499, 500, 10_000, 124_750, 10**9])
def test_the_last_key_within_a_budget(spark, budget):
    df = spark.range(500).select(F.format_string("p%04d", "id").alias("path"), F.col("id").alias("size")).repartition(6)
    inside = [k for k in range(500) if k * (k + 1) // 2 <= budget]
    want = (f"p{inside[-1]:04}" if inside else None, len(inside) < 500)
    assert last_within(df, "path", "size", budget) == want


def test_no_rows_are_within_any_budget(spark):
    assert last_within(spark.createDataFrame([], "path string, size long"), "path", "size", 5) == (None, False)
