"""Rows repeated with the same id, and ids with several texts."""

import numpy as np

from corpusmill.llm import neardup, nearest


def test_nearest_of_copies_whose_rows_are_repeated(spark):
    group, pair, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.1, 0.0, 1.0]
    rows = [(i, group) for i in range(50, 57) for _ in range(2)] + [(100, pair)] * 6 + [(101, pair), (7, far)]
    for parts in (1, 3):  # repeats in one batch and over several
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
        out = nearest.nearest(df).orderBy("query_id", "rank").collect()
        near = {q: [r["vec_id"] for r in out if r["query_id"] == q] for q in (50, 100)}
        assert near[50] == [51, 52, 53, 54, 55]
        assert near[100][0] == 101 and 100 not in near[100]
        assert {r["query_id"] for r in out} == {50, 100}


def test_an_id_with_several_texts_loses_no_link(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(90)) for x in "ab")
    rows = [(1, a), (1, b), (2, a), (3, b + " x"), (0, a)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        out = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()}
        assert out == {(0, 86): (0, True), (1, 86): out[1, 86], (2, 86): (0, False), (3, 87): (1, False)}
        groups = {(r["doc_id"], r["text_key"]): r["group"] for r in neardup.groups(df).collect()}
        assert len(groups) == 5 and len(set(groups.values())) == 2


def test_one_row_of_each_group_stays(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(90)) for x in "ab")
    rows = [(1, a, 5, "k"), (1, a, 4, "k"), (1, a, 4, "k"), (1, b, 1, None), (2, a, 0, "k"), (0, a + " x", 9, "z"), (3, b + " x", 2, "k"), (4, None, 1, "k"), (4, "", 1, "k"), (None, a, 1, "k"), (None, a, 1, "k"), (6, "c d", 1, "k"), (6, "c d", 1, "k"), (6, "c d", 0, "k")]
    for options in ({}, {"broadcast_ids": 0, "one_task": 0}):
        df = spark.createDataFrame(rows, "doc_id long, text string, n int, _key string").repartition(3)
        out = neardup.one_of_each(df, **options)
        assert out.columns == df.columns
        assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, b, 1, None), (0, a + " x", 9, "z"), (4, None, 1, "k"), (4, "", 1, "k"), (None, a, 1, "k"), (None, a, 1, "k"), (6, "c d", 0, "k")], key=repr)


def test_common_sizes_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n)) for n in (0, 1, 40, 200, 200, 7)]
    found = neardup.common_sizes(sets, columns=16)
    assert found.tolist() == [[len(set(x.tolist()) & set(y.tolist())) if i != j else found[i, i] for j, y in enumerate(sets)] for i, x in enumerate(sets)]
