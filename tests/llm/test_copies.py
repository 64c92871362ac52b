"""Exact duplicates against brute force, with digests weak enough to clash."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import copies

DOCS = [(1, "a"), (2, "a"), (7, "a"), (3, "b"), (4, None), (5, ""), (6, "A"), (None, "a"), (8, "a "), (9, "x" * 300_000), (10, "x" * 300_000), (11, "x" * 299_999 + "y"), (12, "r"), (12, "r"), (None, "n"), (None, "n"), (13, "é"), (14, "é")]
SCHEMA = "doc_id long, text string, digest string, salt int, n long, sha string, keep_id long, id int, c0 int"


def frame(spark, rows=DOCS):
    return spark.createDataFrame([(i, t, "d", 1, 2, "s", 3, 4, k % 2) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(5)


def expected(rows=DOCS, normal=lambda t: t):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t or ""), []).append(i)
    out = []
    for i, t in rows:
        own = groups[normal(t or "")]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(normal(t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"salts": 1}, {"digest": lambda t: F.length(t) % 3}, {"digest": lambda t: F.lit(1), "salts": 3}, {"digest": lambda t: F.length(t) % 2, "broadcast_digests": 0}])
def test_groups_equal_brute_force(spark, options):
    assert rows_of(copies.copy_report(frame(spark), **options)) == expected()


def test_texts_are_compared_after_the_given_change(spark):
    assert rows_of(copies.copy_report(frame(spark), normal=lambda t: F.lower(F.trim(t)))) == expected(normal=lambda t: t.strip(" ").lower())


def test_empty_table(spark):
    assert copies.copy_report(frame(spark, [])).collect() == []
    assert copies.drop_exact_copies(frame(spark, [])).collect() == []


def test_a_group_of_a_third_of_all_rows_is_dealt_out(spark):
    rows = [(k, "hot") for k in range(3000)] + [(3000 + k, f"t{k // 2}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    out = copies.copy_report(df).toPandas()
    assert len(out) == 9000 and out.kept.sum() == 3001
    hot = out[out.doc_id < 3000]
    assert set(hot.keep_id) == {2999} and set(hot.group_size) == {3000}
    salts = df.select(copies._salt(256)).distinct().count()
    assert salts > 8


def test_what_stays(spark):
    docs = frame(spark)
    out = copies.drop_exact_copies(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"] or "") for r in out.collect()), key=repr)
    keep = {(i, t or "") for i, t in DOCS}
    best = {}
    for i, t in keep:
        if t not in best or (i is not None and (best[t] is None or i > best[t])):
            best[t] = i
    assert got == sorted(((i, t) for t, i in best.items()), key=repr)
    # of repeated rows the one with the smallest columns stays
    assert [r["c0"] for r in out.collect() if r["doc_id"] == 12] == [0]


def test_no_python_on_the_executors(spark):
    plan = copies.copy_report(frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
