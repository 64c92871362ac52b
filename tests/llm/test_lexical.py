"""Ranked lexical search against brute force, and its compressed blocks."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import lexical
from corpusmill.llm.lexical import COLUMNS, Impacts, Shard
from corpusmill.llm.postings import Lists, from_bytes, inverted, to_bytes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, most=50):
    counts = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def corpus(seed, n, words=60, most=80):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, words + 1)
    return [(int(i), " ".join(f"w{k}" for k in rng.choice(words, rng.integers(0, most), p=p / p.sum()))) for i in rng.permutation(n)]


SCHEMA = "doc_id long, text string, shard int, term string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "t", 2) for i, t in rows], SCHEMA)


def test_ranks_equal_brute_force(spark):
    docs = corpus(1, 700)
    items = [(k, t) for k, (_, t) in enumerate(corpus(2, 25, most=20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    for options, more in (({}, {}), ({"shard_bytes": 3000, "block": 4}, {}), ({"shard_bytes": 20_000, "block": 16}, {"query_bytes": 200})):
        index = lexical.build_index(frame(spark, docs).repartition(3), **options)
        assert rows_of(lexical.search(index, bench, **more)) == expected


def test_awkward_documents_and_items(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "A a b"), (5, "a A B"), (None, "a a b"), (6, "à voilà Å x\u0085y a\u00a0b"), (7, "x " * 60_000), (8, "a"), (8, "a"), (9, "中文 a 中文"), *((100 + k, "same words here") for k in range(120))]
    items = [(1, "a B"), (1, "a B"), (2, None), (3, ""), (4, "nowhere"), (5, "À voilà"), (6, "à Å 中文"), (7, "x"), (None, "same"), (8, "same same Words"), (9, "a a a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(lexical.rank_documents(frame(spark, docs).repartition(2), bench)) == brute(docs, items)
    assert lexical.rank_documents(frame(spark, []), bench).collect() == []
    assert lexical.rank_documents(frame(spark, [(1, None)]), bench).collect() == []
    assert lexical.rank_documents(frame(spark, docs), bench.limit(0)).collect() == []
    named = spark.createDataFrame([("q", "a B")], "item_id string, text string")
    assert rows_of(lexical.rank_documents(frame(spark, docs), named, 3)) == brute(docs, [("q", "a B")], 3)


def test_numbers_survive_their_bytes():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(0, 300, 500), rng.integers(0, 1 << 62, 500), [0, 127, 128, (1 << 63) - 1]])
    data, size = to_bytes(x)
    assert len(data) == size.sum() and from_bytes(data).tolist() == x.tolist() and len(from_bytes(b"")) == 0


@pytest.mark.parametrize("block", [1, 3, 64])
def test_blocks_hold_the_postings_and_their_largest_impact(block):
    texts = [t.encode() for _, t in corpus(5, 300)]
    n, columns = inverted(texts, block)
    lists = Lists.of({c: columns[c].to_pylist() for c in COLUMNS}, lambda k, tf, n: 1000 * tf // (tf + n))
    counts = [Counter(t.decode().split()) for t in texts]
    for k, term in enumerate(columns["term"].to_pylist()):
        own = [(d, c[term.decode()]) for d, c in enumerate(counts) if term.decode() in c]
        blocks = np.arange(lists.first[k], lists.first[k + 1])
        of, doc, tf = lists.postings(blocks)
        assert list(zip(doc.tolist(), tf.tolist(), strict=True)) == own and columns["df"][k].as_py() == len(own)
        for b in blocks:
            inside = own[(b - blocks[0]) * block : (b - blocks[0] + 1) * block]
            assert lists.last[b] == inside[-1][0] and lists.top[b] == max(1000 * f // (f + n[d]) for d, f in inside)
        assert (of == np.repeat(np.arange(len(blocks)), np.minimum(block, len(own) - block * np.arange(len(blocks))))).all()


def test_blocks_below_the_threshold_stay_compressed():
    rng = np.random.default_rng(3)
    texts = ["common " + " ".join(f"p{k}" for k in rng.integers(0, 5000, 60)) for _ in range(4000)]
    for k in range(64, 128):
        texts[k] = "common other " * 30
    for k in range(300, 4000, 2):
        texts[k] += " other"
    n, columns = inverted([t.encode() for t in texts])
    rows = {t: {c: columns[c][i].as_py() for c in COLUMNS} for i, t in enumerate(columns["term"].to_pylist())}
    df = dict(zip(columns["term"].to_pylist(), columns["df"].to_pylist(), strict=True))
    shard = Shard(rows, n, Impacts(len(texts), int(n.sum()), df))
    doc, _ = shard.search([b"common", b"other"], 10, 0)
    assert set(doc.tolist()) <= set(range(64, 128)) and len(doc) >= 10
    assert shard.opened < (df[b"common"] + df[b"other"]) / 64 / 4
