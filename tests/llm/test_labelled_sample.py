"""The labelled rows that a classifier may learn from."""

import pytest
from pyspark.sql import functions as F

from corpusmill.llm.learn import fold, labelled_sample
from corpusmill.llm.quality import quality_scores


def ids_by_hash(spark, n, folds=5, held_out=0):
    """Ids outside the held-out fold, first by hash first."""
    return [r["doc_id"] for r in spark.range(n).select(F.col("id").alias("doc_id")).where(fold("doc_id", folds) != held_out).orderBy(F.xxhash64("doc_id")).collect()]


def tables(spark, texts, quality):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, y in quality.items()], "doc_id long, quality int")


def test_a_very_long_text_that_comes_first_does_not_empty_its_class(spark):
    ids = ids_by_hash(spark, 60)
    good, bad = ids[1::2], ids[::2]
    texts = {i: f"good words here number {i} and some more" for i in good} | {i: "xx " * (3 + i % 5) for i in bad}
    texts[bad[0]] = "yy " * 1_900_000  # 5.7 MB, first by hash, more than the bound
    docs, labels = tables(spark, texts, {i: 1 for i in good} | {i: 0 for i in bad})
    sample = labelled_sample(docs, labels, "quality", 5, 0, 400)
    assert sorted(t.decode() for t, y in sample if y == 0) == sorted(texts[i] for i in bad[1:])
    assert sorted(t.decode() for t, y in sample if y == 1) == sorted(texts[i] for i in good)
    predicted = {r["doc_id"]: r["predicted"] for r in quality_scores(docs, labels).collect()}
    assert {predicted[i] for i in good} == {1} and {predicted[i] for i in bad[1:]} == {0}


def test_bytes_are_filled_in_hash_order_and_what_does_not_fit_is_passed_over(spark):
    ids = ids_by_hash(spark, 12)
    sizes = [10, 95, 20, 8, 90, 60]
    docs, labels = tables(spark, {i: "x" * n for i, n in zip(ids, sizes, strict=False)}, dict.fromkeys(ids, 1))
    # over an eighth of 800: none; 10 + 95 fit; of 120 bytes the long ones (over 15) come last, the shortest first
    assert len(labelled_sample(docs, labels, "quality", 5, 0, 400, 800)) == 6
    assert sorted(len(t) for t, _ in labelled_sample(docs, labels, "quality", 5, 0, 400, 120)) == [8, 10, 20, 60]
    assert sorted(len(t) for t, _ in labelled_sample(docs, labels, "quality", 5, 0, 2, 800)) == [10, 95]


def test_labels_without_a_document_take_no_place(spark):
    ids = ids_by_hash(spark, 100)
    with_text = ids[-5:]
    docs, labels = tables(spark, {i: f"text {i}" for i in with_text}, dict.fromkeys(ids, 1))
    assert len(labelled_sample(docs, labels, "quality", 5, 0, 3)) == 3
    assert len(labelled_sample(docs, labels, "quality", 5, 0, 400)) == 5
    assert labelled_sample(docs.limit(0), labels, "quality", 5, 0, 400) == []


def test_a_class_of_which_nothing_fits_is_an_error(spark):
    ids = ids_by_hash(spark, 10)[:4]
    docs, labels = tables(spark, {ids[0]: "a", ids[1]: "b", ids[2]: "x" * 500, ids[3]: "y" * 400}, {ids[0]: 0, ids[1]: 0, ids[2]: 1, ids[3]: 1})
    with pytest.raises(ValueError, match="quality = 1: the shortest labelled text has 400 bytes"):
        labelled_sample(docs, labels, "quality", 5, 0, 400, 300)
    assert len(labelled_sample(docs, labels, "quality", 5, 0, 400, 450)) == 3
