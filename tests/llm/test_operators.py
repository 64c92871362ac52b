"""Each operator on small tables with every awkward case, against brute force:
null and empty texts, very long ones, ties, repeated rows, null ids, empty
tables, and extra columns whose names clash with those an operator uses."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import decontaminate, licenses, nearest, neardup, packing, pii, quality, repeats, tokens, toxicity
from corpusmill.llm.components import connected

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _found string, _t int, node long, key string, c0 int"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


BASE = prose(1, 120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
DOCS = [
    (1, BASE),
    (2, BASE),
    (3, NEAR),
    (4, prose(2, 90)),
    (5, None),
    (6, ""),
    (7, " \n\t "),
    (8, prose(3, 30_000)),
    (9, "short text"),
    (9, "short text"),
    (None, prose(4, 40)),
    (10, "Écrivez à bob.smith@mail.example.com, +1 (555) 010-9999, 10.0.0.255 and 4539 1488 0343 6467 🙂 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""),
    (11, prose(5, 50) + " Licensed under the GNU General Public License. CC BY 4.0. " + prose(6, 50)),
    (12, prose(7, 80) + " " + BASE + " " + prose(8, 80)),
    (13, "<|endoftext|> it's  fine\n\nx"),
]


def frame(spark, rows=DOCS):
    full = [(i, t, "en", f"s{k % 2}", len(t or ""), 0.5, "x", 1, 2, "k", 3) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(PATH)
    expected = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in DOCS]
    assert rows_of(tokens.token_counts(docs, PATH)) == sorted(expected, key=repr)
    assert tokens.token_counts(empty, PATH).count() == 0


def test_packing(docs, empty):
    library = Tokenizer.from_file(PATH)
    out = packing.pack(docs, PATH).toPandas()
    ids = {}
    for i, t in DOCS:
        ids[i] = [*library.encode(t or "", add_special_tokens=False).ids, 1]
    for (doc, start), g in out.fillna({"doc_id": -1}).groupby(["doc_id", "start"]):
        own = ids[None if doc == -1 else int(doc)]
        for r in g.itertuples():
            part = np.array(own[start : start + r.length], "<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32 and r.doc_tokens == len(own) and len(part) == 4 * r.length
    assert out.length.sum() == sum(len(ids[i]) for i, _ in DOCS)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert sorted(out.sequence_id.unique()) == list(range(out.sequence_id.nunique()))
    assert packing.pack(empty, PATH).count() == 0


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text):
    return re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_decontamination(spark, docs, empty):
    items = [(1, " ".join(BASE.split()[20:40])), (2, "short, TEXT"), (3, None), (4, "..."), (5, "nowhere to be found"), (2, "short text"), (None, BASE[:200])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for item, text in items:
        w = word_list(text)
        for k in range(max(len(w) - 13, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(item)
    expected = []
    for i, t in DOCS:
        w, hit, found = word_list(t), set(), set()
        for win, own in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= own
        names = sorted(str(x) for x in found if x is not None)
        expected.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert rows_of(decontaminate.decontamination_report(docs, benchmark)) == sorted(expected, key=repr)
    assert decontaminate.decontamination_report(empty, benchmark).count() == 0
    assert not decontaminate.decontamination_report(docs, benchmark.limit(0)).where("n_hit > 0").count()
    one, many = (decontaminate.find_contamination(docs.select("doc_id", "text"), benchmark, most_bytes=n).select("doc_id", F.col("_found.n_hit").alias("n"), F.col("_found.spans").alias("s"), F.col("_found.items").alias("i")) for n in (1 << 20, 300))
    assert rows_of(one) == rows_of(many)
    for r in one.where("doc_id = 12").collect():
        text = dict(DOCS)[12].encode()
        assert any(text[s["start"] : s["end"]].decode().startswith(BASE[:20]) or BASE.split()[20] in text[s["start"] : s["end"]].decode() for s in r["s"])
    clash = decontaminate.find_contamination(docs, benchmark)
    assert clash.columns == [*docs.columns, "_found"] and clash.count() == len(DOCS)


def test_licenses(docs, empty):
    out = {(r["doc_id"], r["n_words"]): r for r in licenses.scan_licenses(docs).collect()}
    for i, t in DOCS:
        w = word_list(t)
        places = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = out[i, len(w)]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert licenses.scan_licenses(empty).count() == 0


def test_license_tags(spark):
    rows = [(1, "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nbody"), (2, "SPDX-License-Identifier:"), (3, "license-expression: GPL-2.0-only WITH Classpath-exception-2.0")]
    out = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert out[1]["labels"] == "apache-2.0,bsd-3-clause,mit" and out[1]["strictness"] == 1
    assert out[2]["labels"] == "expression-invalid" and out[2]["strictness"] is None
    assert out[3]["labels"].startswith("exception:classpath") and out[3]["strictness"] == 2


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def components(rows):
    sets, up = [(i, shingle_set(t)) for i, t in rows if i is not None], {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in up}


def family(seed, n):
    """Chains of edited copies: linked to neighbours, not to the first."""
    out, w = [], prose(seed, 150).split()
    rng = np.random.default_rng(seed)
    for _ in range(n):
        out.append(" ".join(w))
        w = list(w)
        for k in rng.choice(150, rng.integers(1, 9), replace=False):
            w[k] = f"e{rng.integers(1 << 30)}"
    return out


@pytest.mark.parametrize("options", [{}, {"block": 7, "one_task": 0, "broadcast_ids": 0}, {"elements": 700}])
def test_near_duplicates(spark, options):
    rows = [*DOCS, *((100 + k, t) for k, t in enumerate(family(11, 40) + family(12, 30)))]
    out = neardup.near_duplicates(frame(spark, rows), **options).collect()
    expected = components(rows)
    assert len(out) == len(rows)
    for r in out:
        i = r["doc_id"]
        assert r["component_id"] == expected.get(i) and r["kept"] == (i is None or expected[i] == i)
    assert {(r["doc_id"], r["n_shingles"]) for r in out} == {(i, len(shingle_set(t))) for i, t in rows}


def test_near_duplicates_of_nothing(spark, empty):
    assert neardup.near_duplicates(empty).count() == 0
    assert {r["kept"] for r in neardup.near_duplicates(frame(spark, [(1, None), (2, ""), (3, "x")])).collect()} == {True}


def test_components_by_tasks(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2)) if a != b] + [(k, k + 1) for k in range(1000, 1060)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    assert rows_of(connected(links, one_task=0)) == rows_of(connected(links))
    assert connected(links.limit(0), one_task=0).count() == 0


@pytest.mark.parametrize("options", [{}, {"group": 0, "broadcast_keys": 0}])
def test_repeats(spark, docs, empty, options):
    rows = [*DOCS, (20, prose(8, 80) + "é" * 150), (21, "é" * 150), (22, "ab" * 400), (23, prose(3, 30_000)[5000:5900])]
    raws = [(i, (t or "").encode()) for i, t in rows]
    count = {}
    for _, t in raws:
        for k in range(len(t) - 199):
            count[t[k : k + 200]] = count.get(t[k : k + 200], 0) + 1
    expected = []
    for i, t in raws:
        cover = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                cover[k : k + 200] = True
        kept = bytes(b for b, c in zip(t, cover, strict=False) if not c)
        expected.append((i, len(t), int(cover.sum()), int((np.diff(cover.astype(int), prepend=0) == 1).sum()), kept))
    out = [(r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in repeats.remove_repeats(frame(spark, rows), **options).collect()]
    assert sorted(out, key=repr) == sorted(expected, key=repr)
    assert repeats.remove_repeats(empty, **options).count() == 0


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


DIGITS = lambda v: re.sub("[^0-9]", "", v)
RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(DIGITS(v)) <= 19 and luhn(DIGITS(v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(DIGITS(v)) <= 15),
]
TRICKY = ["a@b.c@d.e", "x@y.z_q@r.s", "..a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "1 2345678901234567-8", "4539148803436467 4539148803436467", "12--4539148803436467", "+1+15550109999", "+1.............9", "é+49 (30) 1234567🙂 a@b.de", "a" * 5000 + "@", "1" * 5000, "0.0.0.00000000000000000000255", "7 4539148803436467", "4539-1488-0343-6467-", "user@host", "+12345678 90123456"]


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, pattern, ok in RULES for m in re.finditer(pattern, text or "") if ok(m[0])]


def test_personal_data(spark, docs, empty):
    rng = np.random.default_rng(5)
    letters = list("0123456789 .-+@()ab")
    rows = [*DOCS, *((50 + k, t) for k, t in enumerate(TRICKY)), *((200 + k, "".join(rng.choice(letters, 60))) for k in range(300))]
    out = pii.pii_report(frame(spark, rows)).collect()
    expected = sorted(((i, hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["base_sha256"]) for r in out), key=repr) == expected
    texts = dict(rows)
    for r in out:
        if r["doc_id"] is not None:
            spans = r["spans"].split(",") if r["spans"] else []
            assert [s for s in spans if s.split(":")[0] in pii.BASE] == base_spans(texts[r["doc_id"]])
            assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s.startswith(f"{k}:") for s in base_spans(texts[r["doc_id"]])) for k in pii.BASE]
    ten = next(r["spans"] for r in out if r["doc_id"] == 10)
    assert "secret:" in ten
    assert pii.pii_report(empty).count() == 0


def test_redaction_keeps_columns_and_clean_texts(docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.where("doc_id is not null").collect()}
    assert all(texts[i] == t for i, t in DOCS if i not in (None, 10))
    assert texts[10] == 'Écrivez à [EMAIL], [PHONE], [IP] and [CARD] 🙂 token = "[SECRET]"'


def test_tree_features_are_the_same_in_spark_and_in_training(spark):
    rows = [r for kind in pii.GENERATORS for r in pii.examples(kind, 60, 3)[0]]
    df = spark.createDataFrame(rows, "v string, c string").coalesce(1)
    out = df.select(*[f(F.col("v"), F.col("c")).cast("double").alias(n) for n, f, _ in pii.FEATURES]).toPandas().to_numpy()
    assert (out == np.array([[g(v, c) for _, _, g in pii.FEATURES] for v, c in rows], float)).all()
    for kind, (trees, least) in pii.models().items():
        held, y = pii.examples(kind, 400, 9)
        logit = trees.logit(np.array([[g(v, c) for _, _, g in pii.FEATURES] for v, c in held], float))
        chosen = logit >= least
        assert np.array(y)[chosen].mean() > 0.9 and chosen[np.array(y) == 1].mean() > 0.7


@pytest.mark.parametrize("options", [{}, {"part_rows": 400, "query_rows": 9, "broadcast_pairs": 0}])
def test_nearest(spark, options):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 12)).astype(np.float32)
    x[100:700] = x[100]  # a large group of copies, queries among them
    rows = [(k, x[k].tolist()) for k in range(3000)]
    bad = [(5000, None), (5050, [0.0] * 12), (5100, [float("nan")] + [1.0] * 11), (5150, [float("inf")] * 12), (5200, [None] + [1.0] * 11), (5250, [1.0] * 3), (None, [1.0] * 12)]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows + bad], "vec_id long, embedding array<float>, score double, rank int")
    out = nearest.nearest(df, sample_rows=1500, **options).toPandas()
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits, total = 0, 0
    for q in range(0, 3000, 50):
        s = y @ y[q]
        s[q] = -9
        best = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        got = out[out.query_id == q].sort_values("rank")
        assert got["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(got.score, s[got.vec_id], atol=1e-12, rtol=0) and q not in set(got.vec_id)
        hits, total = hits + len(set(best) & set(got.vec_id)), total + 5
        if 100 <= q < 700:
            assert got.vec_id.tolist() == best.tolist()
    assert hits / total >= 0.9 and out.query_id.nunique() == 60
    few = nearest.nearest(df.where("vec_id in (0, 1, 50)")).toPandas()
    assert sorted(few.query_id.value_counts().to_dict().items()) == [(0, 2), (50, 2)]
    assert nearest.nearest(df.where("vec_id >= 5000")).count() == 0 and nearest.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_tables(spark, folder):
    df = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    own = df.toPandas()
    x = np.stack(own.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = nearest.nearest(df).toPandas()
    hits, total = 0, 0
    for q in np.flatnonzero(own.vec_id % 50 == 0):
        s = x @ x[q]
        s[q] = -9
        best = set(own.vec_id.to_numpy()[np.lexsort((own.vec_id, -np.round(s, 12)))[:5]])
        hits, total = hits + len(best & set(out[out.query_id == own.vec_id[q]].vec_id)), total + 5
    assert hits / total >= 0.95


def labelled(spark, bad, n=240):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for k in range(n):
        y = int(rng.random() < 0.4)
        rows.append((k, bad(rng, prose(k, int(rng.integers(20, 120))), y)))
        labels.append((k, y, y))
    return frame(spark, [*rows, *((1000 + i if i else None, t) for i, t in DOCS)]), spark.createDataFrame([*labels, (None, 1, 1), (9999, None, None)], "doc_id long, quality int, toxic int"), {i: y for i, y, _ in labels}


def test_quality(spark, empty):
    shout = lambda rng, t, y: t if y else t.upper().replace(" ", "!! ")
    docs, labels, truth = labelled(spark, shout)
    out = quality.quality_scores(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    held = out[out.held_out & out.doc_id.isin(list(truth))]
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.9
    assert all(bool(h) == (zlib.crc32(str(int(i)).encode()) % 5 == 0) for i, h in zip(out.doc_id, out.held_out, strict=True) if not pd.isna(i))
    assert (out.predicted == (out.score >= 0.3)).all()
    assert quality.quality_scores(empty, labels).count() == 0
    assert set(quality.quality_scores(docs, labels.limit(0)).toPandas().score) == {0.5}
    assert set(quality.quality_scores(docs, labels.where("quality = 1")).toPandas().score) == {1.0}


def test_toxicity(spark, empty):
    def insult(rng, t, y):
        w = t.split()
        if y:
            w[int(rng.integers(len(w)))] = str(rng.choice(["grumbol", "snarkle", "blorghast"]))
        return " ".join(w)

    docs, labels, truth = labelled(spark, insult)
    out = toxicity.toxicity_scores(docs, labels).toPandas()
    held = out[out.held_out & out.doc_id.isin(list(truth))]
    assert len(out) == docs.count() and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.7)).all()
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.9
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert set(toxicity.toxicity_scores(docs, labels.limit(0)).toPandas().score) == {0.5}
    clash = toxicity.score_toxicity(docs, 0.25, "toxic_score")
    assert clash.columns == [*docs.columns, "toxic_score"] and clash.count() == docs.count()


def test_whole_long_text_is_scored(spark):
    sample = [(prose(k, 60).encode(), 0) for k in range(200)] + [((prose(k, 30) + " vile " + prose(k + 1, 30)).encode(), 1) for k in range(200)]
    model = toxicity.train(sample, 0.7)
    clean = prose(700, 4000)
    low, high = model.scores([clean.encode(), (clean + " vile").encode()])
    assert low < 0.7 <= high
