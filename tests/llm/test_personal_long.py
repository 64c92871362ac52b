"""Personal data in very long and very dense texts, and against brute force."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import pii


def texts_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(8)
    parts = ["é🙂", " ", "a@b.de", "1.2.3.4", "token=04dbebab91ab85687d33eeaa", "+1 555 010 9999", "4539148803436467", "phone 030 123 4567", "\n", "text " * 60, "IBAN DE89370400440532013000"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(60)]


def test_places_and_contexts_equal_python(spark, mixed):
    df = texts_frame(spark, mixed)
    for pattern in (r"[A-Za-z0-9+/_-]{16,}+={0,2}", r"[0-9]+", "é"):
        spans = pii.matches(F.col("text"), pattern)
        before = F.transform(spans, lambda s: pii.between(pii.pieces(F.col("text")), F.greatest(s["start"] - 300, F.lit(0)), s["start"]))
        for r in df.select("text", spans.alias("s"), before.alias("b")).collect():
            found = list(re.finditer(pattern, r["text"]))
            assert [(s["start"], s["end"], s["value"]) for s in r["s"]] == [(m.start(), m.end(), m[0]) for m in found]
            assert r["b"] == [r["text"][max(m.start() - 300, 0) : m.start()] for m in found]


def test_redaction_equals_brute_force(spark, mixed):
    df = texts_frame(spark, mixed)
    spans = {r["doc_id"]: r["s"] for r in pii.find_personal_data(df, spans_col="s").collect()}
    some = 0
    for r in pii.redact(df).collect():
        text, out, at = mixed[r["doc_id"]], "", 0
        for s in sorted(spans[r["doc_id"]], key=lambda s: (s["start"], -s["end"], s["kind"])):
            if s["start"] >= at:
                out += text[at : s["start"]] + f"[{s['kind'].upper()}]"
                some += 1
            at = max(at, s["end"])
        assert r["text"] == out + text[at:]
    assert some > 100


@pytest.mark.parametrize("value", ["a@b.de", "04dbebab91ab85687d33", "1.2.3.4"])
def test_time_is_linear_in_dense_texts(spark, value):
    text = (value + " ") * (1_000_000 // (len(value) + 1))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.redact(df.limit(0)).collect()
    for run in (pii.pii_report, pii.redact):
        start = time.time()
        run(df).write.format("noop").mode("overwrite").save()
        assert time.time() - start < 20


def test_keys_and_values_without_spaces(spark):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [f"API_KEY={secret} x", f"config password:{secret}", f"export GITHUB_ACCESS_TOKEN_VALUE={secret}", "SOME_LONG_CONSTANT_NAME=other_long_constant_name"]
    out = [r["spans"] for r in pii.pii_report(texts_frame(spark, rows)).orderBy("doc_id").collect()]
    assert out == [*(f"secret:{t.index(secret)}:{t.index(secret) + 40}" for t in rows[:3]), ""]


def test_running_sums(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.integers(0, 9, n).tolist(),) for n in (0, 1, 2, 3, 7, 8, 9, 1000)]
    for r in spark.createDataFrame(rows, "a array<bigint>").select("a", pii.running(F.col("a")).alias("s")).collect():
        assert r["s"] == np.cumsum(r["a"]).tolist()
