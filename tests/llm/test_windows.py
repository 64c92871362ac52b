"""Windows of benchmark items, found by their blocks, against brute force."""

import random
import re

import pytest

from corpusmill.llm.decontaminate import Benchmark, decontamination_report
from corpusmill.llm.normal import Normal


def brute(words, items, n):
    hit, found = set(), set()
    for name, text in items:
        w = text.split()
        for k in range(max(len(w) - n, 0) + 1 if w else 0):
            part = w[k : k + n]
            for s in range(len(words) - len(part) + 1):
                if words[s : s + len(part)] == part:
                    hit.update(range(s, s + len(part)))
                    found |= {name} - {None}
    return hit, sorted(found)


def test_hits_equal_brute_force():
    rng = random.Random(5)
    for n in (1, 2, 5, 13):
        for _ in range(60):
            letters = "ab" if rng.random() < 0.5 else "abcdefgh"
            text = lambda least, most: " ".join(rng.choice(letters) for _ in range(rng.randint(least, most)))
            items = [(rng.choice([None, "1", "2", "3", "10"]), text(0, 3 * n)) for _ in range(6)]
            bench = Benchmark([(i, t.encode()) for i, t in items], n).prepare()
            docs = [text(0, 4 * n), *(f"{text(0, n)} {t} {text(0, n)}" for _, t in items)]
            for d in docs:
                runs, found = bench.hits(Normal(d.encode()))
                assert ({k for s, e in runs for k in range(s, e)}, found) == brute(d.split(), items, n)


def test_the_automaton_holds_each_word_once():
    words = [f"w{k}" for k in range(5000)]
    bench = Benchmark([("1", " ".join(words).encode())]).prepare()
    assert len(bench.machine) <= 5000 / 7 + 1 and len(bench.hashes) == 5000 - 12


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


#: Words whose UTF-8 holds the bytes 85 and A0, which Latin-1 takes for spaces:
#: accented letters, Chinese and Japanese, an ellipsis, an emoji, and the
#: no-break space and the next-line sign themselves, which are of words too.
ODD = ["voilà", "Åse", "à", "Å", "中文", "丅", "光", "酠", "…", "😅", "a b", " ", "\u0085", "x\u0085y"]


@pytest.mark.parametrize("odd", ODD)
@pytest.mark.parametrize("place", [0, 6, 7, 12])
def test_word_bytes_that_latin1_takes_for_spaces(odd, place):
    plain = [f"word{k}" for k in range(13)]
    inside = [*plain[:place], odd, *plain[place + 1 :]]
    bench = Benchmark([("in", " ".join(inside).encode()), ("plain", " ".join(plain).encode()), ("short", f"{odd} end".encode())]).prepare()
    for before, after in (("", ""), (odd, ""), ("", odd), (f"x {odd} {odd} y", f"{odd}, z")):
        for items, own in ((inside, "in"), (plain, "plain")):
            text = f"{before} {' '.join(items)} {after}".strip(" ")
            runs, found = bench.hits(Normal(text.encode()))
            w, hit, names = words_of(text), set(), set()
            for name, item in (("in", inside), ("plain", plain), ("short", [odd, "end"])):
                item = words_of(" ".join(item))
                for s in range(len(w) - len(item) + 1):
                    if item and w[s : s + len(item)] == item:
                        hit.update(range(s, s + len(item)))
                        names.add(name)
            assert ({k for s, e in runs for k in range(s, e)}, found) == (hit, sorted(names))
            assert own in found and len(hit) >= 13


def test_random_words_with_odd_bytes_equal_brute_force(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice([*ODD, "b", "c"]) for _ in range(n))
    items = [(k, text(rng.randint(10, 30))) for k in range(8)]
    docs = [(100 + k, f"{text(rng.randint(0, 9))} {' '.join(rng.choice(items)[1].split(' ')[rng.randint(0, 5) :])} {text(rng.randint(0, 9))}") for k in range(60)]
    report = decontamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    windows = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(len(w) - 13, 0) + 1):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    some = 0
    for r in report.collect():
        w, hit, found = words_of(dict(docs)[r["doc_id"]]), set(), set()
        for win, own in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found |= own
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), len(hit) > 0 and 20 * len(hit) >= len(w))
        some += len(hit) > 0
    assert some > 20
