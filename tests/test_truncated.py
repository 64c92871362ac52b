"""Percentiles that are cut to whole numbers."""

from corpusmill import catalog


def test_median_and_p90_are_truncated(spark, tmp_path):
    spark.createDataFrame([(i, "w " * n) for i, n in enumerate((1, 2, 5, 10))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = catalog.queries()["agg_token_truncated"](spark, str(tmp_path)).collect()
    assert (row["median"], row["p90"], row["longest"]) == (3, 8, 10)
