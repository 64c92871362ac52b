"""Bootstrap weights, intervals and the exact test."""

import hashlib
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators.intervals import mcnemar, paired_bootstrap, poisson_weight


def weight(key, r):
    u = int(hashlib.md5(f"{key}:{r}".encode()).hexdigest()[:13], 16) / 16**13
    k, p, total = 0, np.exp(-1), np.exp(-1)
    while u >= total and k < 9:
        k, p = k + 1, p / (k + 1)
        total += p
    return k


def test_weights_are_poisson_and_the_same_everywhere(spark):
    rows = spark.range(400).select("id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("r")).repartition(3).select("id", "r", poisson_weight(F.col("id"), F.col("r")).alias("w")).collect()
    assert all(x["w"] == weight(x["id"], x["r"]) for x in rows)
    w = np.array([x["w"] for x in rows])
    assert abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.08 and w.max() >= 4


def test_intervals_equal_a_plain_bootstrap(spark):
    rng = np.random.default_rng(2)
    data = [(t, s, (int(rng.integers(0, 2)), 1, None if t == 3 else 0), (int(rng.random() < 0.7), 1, 0)) for t in range(30) for s in range(3)]
    side = "struct<ok:int,one:int,none:int>"
    pairs = spark.createDataFrame(data, f"task long, seed int, parent {side}, candidate {side}")
    found = {r["measure"]: r for r in paired_bootstrap(pairs, "task", {"ok": ("ok", "one"), "empty": ("ok", "none")}, replicates=50, level=0.9).collect()}
    n, a, b = (np.array([sum(f(x) for x in data if x[0] == t) for t in range(30)], float) for f in (lambda x: 1, lambda x: x[2][0], lambda x: x[3][0]))
    d = []
    for r in range(50):
        w = np.array([weight(t, r) for t in range(30)])
        d.append((w @ b - w @ a) / (w @ n))
    r = found["ok"]
    assert (r["parent"], r["candidate"], r["clusters"]) == pytest.approx((a.sum() / 90, b.sum() / 90, 30))
    assert (r["low"], r["high"]) == pytest.approx(tuple(np.quantile(d, [0.05, 0.95]))) and r["low"] < r["delta"] < r["high"]
    assert found["empty"]["delta"] is None and found["empty"]["low"] is None
    assert paired_bootstrap(pairs.limit(0), "task", {"ok": ("ok", "one")}).collect() == []


@pytest.mark.parametrize(("lost", "gained"), [(0, 0), (0, 1), (3, 3), (0, 6), (2, 9), (40, 61), (1500, 1400), (9000, 9700)])
def test_mcnemar_is_the_binomial_tail(spark, lost, gained):
    n, m = lost + gained, min(lost, gained)
    want = min(1.0, float(2 * sum(comb(n, k) for k in range(m + 1)) / (1 << n))) if n < 1000 else min(1.0, 2 * sum(comb(n, k) for k in range(m + 1)) * 10**30 // (1 << n) / 10**30)
    (got,) = spark.createDataFrame([(lost, gained)], "a long, b long").select(mcnemar(F.col("a"), F.col("b"))).first()
    assert got == pytest.approx(want, rel=1e-9)
