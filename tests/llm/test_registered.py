"""Every registered query of the training-data operators on the smallest
tables, and the invariants of its contract."""

import hashlib
import re

import numpy as np
import pytest
from test_operators import base_spans, components, shingle_set, word_list

from corpusmill.llm.queries import queries
from corpusmill.llm.shared import shared_folder

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id held_out score predicted",
    "op2": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4": "doc_id n_bytes n_tokens over_limit",
    "op5": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op6": "doc_id n_shingles component_id kept",
    "op7": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8": "doc_id held_out score predicted",
    "op9": "query_id rank vec_id score",
    "op10": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op11": "item_id rank doc_id score",
    "op12": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op13": "doc_id keep_id group_size kept text_sha256",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def results(spark):
    return {name.split("_")[0]: f(spark, FOLDER).toPandas() for name, f in queries().items()}


@pytest.mark.parametrize("op", COLUMNS)
def test_columns_and_rows(results, texts, op):
    out = results[op]
    assert out.columns.tolist() == COLUMNS[op].split()
    if op not in ("op3", "op9", "op11", "op12"):
        assert sorted(out.doc_id) == sorted(texts)


def test_base_labels(results, texts):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for r in results["op2"].itertuples():
        w = word_list(texts[r.doc_id])
        at = [(k, v) for p, v in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({v for _, v in at})))


def test_packing_fills_its_sequences(results):
    out = results["op3"]
    filled = out.groupby("sequence_id").length.sum()
    assert filled.max() <= 2048 and filled.sum() / (2048 * len(filled)) > 0.98
    own = out.sort_values(["doc_id", "start"])
    assert (own.groupby("doc_id").length.sum() == own.groupby("doc_id").doc_tokens.first()).all()
    for _, g in own.groupby("doc_id"):
        assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]]


def test_contamination(results, texts, spark):
    found = {}
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = word_list(r["text"])
        for k in range(max(len(w) - 13, 0) + 1 if w else 0):
            found.setdefault(tuple(w[k : k + 13]), set()).add(str(r["item_id"]))
    for r in results["op5"].itertuples():
        w, hit, items = word_list(texts[r.doc_id]), set(), set()
        for n in {len(x) for x in found}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in found:
                    hit.update(range(k, k + n))
                    items |= found[tuple(w[k : k + n])]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), len(hit) > 0 and 20 * len(hit) >= len(w))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def test_near_duplicate_components(results, texts):
    expected = components(list(texts.items()))
    for r in results["op6"].itertuples():
        assert (r.component_id, r.n_shingles, r.kept) == (expected[r.doc_id], len(shingle_set(texts[r.doc_id])), expected[r.doc_id] == r.doc_id)


def test_repeated_strings(results, texts):
    raws = {i: t.encode() for i, t in texts.items()}
    count = {}
    for t in raws.values():
        for k in range(len(t) - 199):
            h = hash(t[k : k + 200])
            count[h] = count.get(h, 0) + 1
    for r in results["op7"].itertuples():
        t = raws[r.doc_id]
        cover = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if count[hash(t[k : k + 200])] > 1:
                cover[k : k + 200] = True
        kept = np.frombuffer(t, np.uint8)[~cover].tobytes()
        assert (r.n_removed, r.kept_sha256) == (int(cover.sum()), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize(("op", "threshold"), [("op1", 0.3), ("op8", 0.7)])
def test_scores(results, op, threshold):
    out = results[op]
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= threshold)).all() and 0 < out.held_out.mean() < 1


def test_personal_data(results, texts):
    for r in results["op10"].itertuples():
        base = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in re.split(",", r.spans) if s.split(":")[0] in ("email", "ip", "card", "phone")] == base


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Java:
        def sc(self):
            return self

        getCheckpointDir = isDefined = lambda self: self
        __bool__ = lambda self: False

    class Context:
        master, _jsc = "spark://host:7077", Java()

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())
