"""Unified diffs: read, judged and applied, against difflib."""

import difflib
import random

from pyspark.sql import functions as F

from corpusmill.functions import patches as P


def run(spark, rows):
    df = spark.createDataFrame(rows, "patch string, old array<string>, file string").withColumn("p", P.read_patch(F.col("patch")))
    lines = F.col("p.lines")
    return df.select("p.ok", "p.lines", P.files_of(lines).alias("files"), P.applies(lines, F.col("old"), F.col("file")).alias("applies"), P.patched(lines, F.col("old"), F.col("file")).alias("new")).collect()


def test_patches_of_difflib_give_the_new_text(spark):
    rng = random.Random(4)
    line = lambda: rng.choice(["a", "b", "-- a/x", "++ b/x", "@@ -1,2 +3 @@", "", " c", "\\ no", "é中", "--- a/y", "+"])
    rows, want = [], []
    for k in range(60):
        old = [line() for _ in range(rng.randint(0, 25))]
        new = [line() if rng.random() < 0.2 else x for x in old if rng.random() > 0.1] + [line() for _ in range(rng.randint(0, 2))]
        diff = "\n".join(difflib.unified_diff(old, new, f"a/f{k}", f"b/f{k}", n=rng.randint(0, 3), lineterm=""))
        rows.append((diff, old, f"f{k}"))
        want.append((old, new))
    for r, (old, new) in zip(run(spark, rows), want, strict=True):
        assert r["ok"] and r["applies"] and r["new"] == new
        minus = [x["text"] for x in r["lines"] if x["sign"] == "-"]
        plus = [x["text"] for x in r["lines"] if x["sign"] == "+"]
        assert len(old) - len(minus) + len(plus) == len(new)
        assert all(old[x["old_at"] - 1] == x["text"] for x in r["lines"] if x["sign"] != "+") and all(new[x["new_at"] - 1] == x["text"] for x in r["lines"] if x["sign"] != "-")


def test_a_patch_for_another_text_does_not_apply(spark):
    diff = "--- a/f\n+++ b/f\n@@ -2,2 +2,2 @@\n b\n-c\n+d\n"
    cases = [["a", "b", "c"], ["a", "b", "x"], ["a", "b"], ["b", "c"], []]
    assert [(r["applies"], r["new"]) for r in run(spark, [(diff, old, "f") for old in cases])] == [(True, ["a", "b", "d"]), *[(False, None)] * 4]


def test_files_new_deleted_and_several(spark):
    diff = "diff --git a/x b/x\nindex 1..2 100644\n--- a/x\t2020\n+++ b/x\t2021\n@@ -1 +1 @@\n-o\n+n\n\\ No newline at end of file\n--- /dev/null\n+++ b/new/y\n@@ -0,0 +1,2 @@\n+1\n+2\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n"
    (r,) = run(spark, [(diff, ["o"], "x")])
    assert r["ok"] and r["files"] == ["gone", "new/y", "x"] and r["new"] == ["n"]
    (r,) = run(spark, [(diff, [], "new/y")])
    assert r["new"] == ["1", "2"]
    (r,) = run(spark, [(diff, ["z"], "gone")])
    assert r["new"] == []


def test_broken_patches_are_not_ok(spark):
    head = "--- a/f\n+++ b/f\n"
    bad = [head + "@@ -1,2 +1,2 @@\n a\n", head + "@@ -1 +1 @@\n*a\n+b\n", head + "@@ -1,1 +1,0 @@\n a\n", "@@ -1 +1 @@\n-a\n+b\n"]
    good = ["", head, "some words\n", head + "@@ -1 +1 @@ def f():\n-a\n+b"]
    assert [r["ok"] for r in run(spark, [(p, ["a"], "f") for p in bad + good])] == [False] * 4 + [True] * 4
    assert run(spark, [(None, ["a"], "f")])[0]["ok"] is None


def test_scope_and_precision(spark):
    wanted = "--- a/src/f\n+++ b/src/f\n@@ -1 +1 @@\n-a\n+b\n"
    more = wanted + "--- a/doc/g\n+++ b/doc/g\n@@ -1 +1,2 @@\n a\n+b\n"
    df = spark.createDataFrame([(wanted,), (more,), ("",)], "patch string").withColumn("p", P.read_patch(F.col("patch"))["lines"]).withColumn("w", P.read_patch(F.lit(wanted))["lines"])
    relevant, total = P.precision(F.col("p"), F.col("w"))
    assert [tuple(r) for r in df.select(relevant, total, P.in_scope(F.col("p"), F.lit("src/")), P.in_scope(F.col("p"), F.lit("src/"), F.lit("doc/"))).collect()] == [(2, 2, True, True), (2, 3, False, True), (0, 0, True, True)]
