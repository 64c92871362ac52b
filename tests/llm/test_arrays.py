"""The numpy cores against plain definitions."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import cutting
from corpusmill.llm.anchors import find_anchors
from corpusmill.llm.bpe import Bpe
from corpusmill.llm.components import Forest
from corpusmill.llm.licenses import parse
from corpusmill.llm.minhash import bands, signatures
from corpusmill.llm.quantise import pack, unpack
from corpusmill.llm.suffixes import maximal_repeats
from corpusmill.llm.words import ALNUM, NONSPACE, shingles, words

TEXTS = ["", " ", "Hello World", "a", "é漢字 🙂\tx1", "A\x00b\nC" * 7, "one two three four five six one two three four five six"]


@pytest.mark.parametrize(("table", "pattern"), [(ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (NONSPACE, r"[^\x20\x09-\x0D]+")])
def test_words_are_those_of_the_pattern(table, pattern):
    lower = [t.translate({c: c + 32 for c in range(65, 91)}) for t in TEXTS]
    w = words([t.encode() for t in TEXTS], table)
    expected = [re.findall(pattern, t) for t in lower]
    assert w.counts().tolist() == [len(e) for e in expected]
    by_hash = collections.defaultdict(set)
    for h, x in zip(w.hash.tolist(), (x for e in expected for x in e), strict=True):
        by_hash[h].add(x)
    assert all(len(v) == 1 for v in by_hash.values()) and len(by_hash) == len({x for e in expected for x in e})


def test_shingles_of_short_and_long_texts():
    h, first = shingles(words([b"", b"a b", b"a b c d e f", b"a b"], NONSPACE))
    assert np.diff(first).tolist() == [0, 1, 2, 1] and h[0] == h[3] and len(set(h.tolist())) == 3


def test_tokens_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), Bpe(path)
    rng = random.Random(4)
    parts = ["'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "a", "1", "é", "漢", "!", "<|endoftext|>", "\t", "\x00", "🙂", "٣", "'S", "word", "　"]
    texts = ["", "aaaa" * 500, "\r\n\t   x", *("".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500))]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_many(texts)] == expected
    assert own.count_many(texts).tolist() == [len(e) for e in expected]


def test_memory_of_pre_tokens_is_bounded():
    own = Bpe(public_tokenizers.path("byte_bpe_50k.json"))
    own.MEMORY = 10
    texts = [f"word{i} other{i}" for i in range(40)]
    counts = [own.count_many([t])[0] for t in texts]
    assert counts == own.count_many(texts).tolist()


def test_maximal_repeats_equal_brute_force():
    def brute(strings, least):
        places = collections.defaultdict(set)
        for i, s in enumerate(strings):
            for a in range(len(s)):
                for b in range(a + least, len(s) + 1):
                    places[s[a:b]].add((i, a))
        out = set()
        for w, o in places.items():
            left = {strings[i][a - 1] if a else ("start", i) for i, a in o}
            right = {strings[i][a + len(w)] if a + len(w) < len(strings[i]) else ("end", i, a) for i, a in o}
            if len(o) > 1 and len(left) > 1 and len(right) > 1:
                out.add((len(w), tuple(sorted(o))))
        return out

    rng = random.Random(3)
    for k in range(300):
        strings = [bytes(rng.choice(b"ab\x00" if k % 3 else b"a") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 5))]
        found = [(n, tuple(sorted(o))) for n, o in maximal_repeats(strings, 9)]
        assert set(found) == brute(strings, 9) and len(found) == len(set(found))


def test_equal_strings_choose_equal_anchors():
    rng = np.random.default_rng(1)
    common = rng.integers(97, 123, 300, dtype=np.uint8).tobytes()
    texts = [rng.integers(97, 123, n, dtype=np.uint8).tobytes() + common + b"end" for n in (0, 50, 777)]
    a = find_anchors(texts)
    grams = [set(a.gram[a.text == i].tolist()) for i in range(3)]
    assert len(grams[0] & grams[1] & grams[2]) >= 1
    for i, t in enumerate(texts):  # every string of 200 bytes belongs to one anchor
        own = a.text == i
        starts = np.concatenate([np.arange(s, s + m) for s, m in zip(a.start[own], a.many[own], strict=True)])
        assert sorted(starts.tolist()) == list(range(len(t) - 199))
    assert len(find_anchors([b"", b"short"]).gram) == 0


def test_long_texts_have_anchors_across_segments():
    import corpusmill.llm.anchors as anchors

    text = np.random.default_rng(0).integers(97, 123, 9000, dtype=np.uint8).tobytes()
    whole = find_anchors([text])
    old, anchors._PLACE = anchors._PLACE, 11
    try:
        cut = find_anchors([text])
    finally:
        anchors._PLACE = old
    assert sum(cut.many) == sum(whole.many) == len(text) - 199


def test_signatures_estimate_similarity_and_ignore_order():
    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (900, 100, 100))
    x, y = np.concatenate([common, a]), np.concatenate([b, common])
    sig = signatures(np.concatenate([x, y, x[::-1], x[:3]]), np.array([0, 1000, 2000, 3000, 3003, 3003]), 128)
    assert (sig[0] == sig[2]).all() and abs((sig[0] == sig[1]).mean() - 900 / 1100) < 0.12
    assert (sig[3] < ~np.uint64(0)).all() and (sig[4] == ~np.uint64(0)).all()
    assert (bands(sig)[0] == bands(sig)[2]).all()
    chunked = signatures(np.concatenate([x, y]), np.array([0, 1000, 2000]), 128, at_once=64)
    assert (chunked == sig[:2]).all()


def test_cutting_patterns_meet_demand_with_little_waste():
    rng = np.random.default_rng(0)
    for n in (1, 40, 4000):
        size, demand = np.unique(np.minimum(256, rng.lognormal(4, 1, n).astype(int) + 1), return_counts=True)
        made = cutting.plan(size, demand, 256)
        assert (sum(c * t for c, t in made) == demand).all() and all((c * size).sum() <= 256 for c, _ in made)
        assert sum(t for _, t in made) <= np.ceil((size * demand).sum() / 256) * 1.02 + 2
    assert cutting.plan(np.array([], int), np.array([], int), 256) == []


@pytest.mark.parametrize(
    ("text", "ids", "strictness"),
    [
        ("MIT", {"mit"}, 1),
        ("MIT OR GPL-3.0-only", {"mit", "gpl-3.0-only"}, 1),
        ("(MIT AND GPL-2.0) or Apache-2.0", {"mit", "gpl-2.0", "apache-2.0"}, 1),
        ("GPL-2.0 WITH Classpath-exception-2.0 AND MIT", {"gpl-2.0", "exception:classpath-exception-2.0", "mit"}, 2),
        ("MIT OR", {"mit"}, 1),
    ],
)
def test_licence_expressions(text, ids, strictness):
    terms, _ = parse(text.encode())
    assert terms.ids == ids and terms.strictness == strictness


@pytest.mark.parametrize("text", ["", "AND MIT", "(MIT", ") MIT", "*"])
def test_wrong_licence_expressions(text):
    assert parse(text.encode())[0] is None


def test_four_bit_codes_round_trip():
    codes = np.random.default_rng(0).integers(0, 16, (50, 7)).astype(np.uint8)
    assert (unpack(pack(codes), 7) == codes).all()


def test_forest():
    f = Forest()
    for a, b in ((5, 3), (9, 5), (7, 8)):
        f.join(a, b)
    assert [f.root(x) for x in (3, 5, 9, 7, 8, 1)] == [3, 3, 3, 7, 7, 1]
