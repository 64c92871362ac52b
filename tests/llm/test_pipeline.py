"""The pipeline's stages on a small corpus, and the registered names."""

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline

WORDS = [f"w{i}" for i in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, c0 string, dropped int"


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("data")
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(150):
        toxic = int(rng.random() < 0.3)
        w = prose(k, 60).split()
        if toxic:
            w[int(rng.integers(60))] = "grumbol"
        rows.append((k, " ".join(w)))
        labels.append((k, 1, toxic))
    item = prose(900, 20)
    rows += [(200, prose(500, 80)), (201, prose(500, 80)), (202, item + " " + prose(901, 30)), (203, prose(902, 40) + " mail bob@example.com"), (204, None), (205, ""), (None, prose(903, 30))]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0, "x", 2) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), dict(rows), {i for i, _, t in labels if t}


def test_stages_take_effect(spark, folder):
    path, texts, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = set(kept["toxicity"])
    assert len(toxic & first) <= 2 and len(set(texts) - toxic - first) <= 3
    assert 201 not in kept["near duplicates"] and {200, 204, 205, None} <= set(kept["near duplicates"])
    assert set(kept["near duplicates"]) == first - {201}
    assert set(kept["near duplicates"]) - set(kept["decontamination"]) == {202}
    assert kept["personal data"][203].endswith("mail [EMAIL]") and kept["personal data"][204] is None
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).toPandas()
    assert set(packed.doc_id.dropna()) == set(kept["personal data"]) - {None}
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).select("length").collect())) == sorted((int(n),) for n in packed.length)


def test_stages_on_an_empty_table(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_a_long_text_and_repeated_rows(spark, folder):
    path = folder[0]
    long = prose(950, 60_000)
    rows = [(300, long), (301, long + " more"), (302, prose(951, 40)), (302, prose(951, 40)), (302, prose(952, 40)), (303, "bob@example.com " * 20_000), (304, None), (304, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0, "x", 2) for i, t in rows], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near duplicates"](spark, docs, path)
    assert sorted((r["doc_id"], len(r["text"] or "")) for r in kept.collect()) == sorted((i, len(t or "")) for i, t in [rows[0], rows[2], *rows[4:]])
    clean = stages["personal data"](spark, stages["decontamination"](spark, kept, path), path).collect()
    assert next(r["text"] for r in clean if r["doc_id"] == 303) == "[EMAIL] " * 20_000 and next(r["n_chars"] for r in clean if r["doc_id"] == 303) == 160_000
    packed = stages["packing"](spark, spark.createDataFrame(clean, docs.schema), path).toPandas()
    firsts = packed[packed.start == 0]
    assert len(firsts) == 6 and packed.length.sum() == firsts.doc_tokens.sum()


def test_registered_names():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
