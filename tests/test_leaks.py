"""Components, links between texts and splits that no link crosses."""

from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import links
from corpusmill.operators.bloom import bloom, passes
from corpusmill.operators.components import components
from corpusmill.functions import text as T
from corpusmill.operators.links import bitmaps, exclusions, leak_free_split, link_texts, protected_windows, shared_windows, similar_pairs
from corpusmill.operators.windows import Sets, windows, with_word_count


def brute(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in up)


def graphs():
    rng = np.random.default_rng(2)
    chain = [(k, k + 1) for k in range(60)]
    mixed = list(zip(rng.permutation(61).tolist(), rng.permutation(61).tolist(), strict=True))
    return {
        "none": [],
        "loops and nulls": [(1, 1), (None, 2), (3, None), (5, 4), (4, 5), (5, 4)],
        "chain": chain,
        "shuffled chain": [(a * 37 % 61, b * 37 % 61) for a, b in chain],
        "hub": [(500, k) for k in range(400)] + [(k, k + 1000) for k in range(0, 400, 7)],
        "random": mixed + [(k + 100, int(x) + 100) for k, x in enumerate(rng.integers(0, 90, 60))],
        "negative": [(-5, 3), (3, 8), (-9, 8), (10, 11)],
    }


@pytest.mark.parametrize(("name", "hot"), [*((n, 100_000) for n in graphs()), ("hub", 3), ("random", 3)])
def test_components_equal_union_find(spark, name, hot):
    links = graphs()[name]
    found = components(spark.createDataFrame(links, "a long, b long"), hot)
    assert sorted(map(tuple, found.collect())) == brute(links)


def corpus():
    rng = np.random.default_rng(7)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 500, n)]
    texts, at = {}, 0
    for _ in range(6):  # families in which each text is near the one before, the ends far apart
        now = word(60)
        for _ in range(8):
            texts[at] = " ".join(now)
            at += 1
            now = [*now]
            now[int(rng.integers(0, 60))] = f"x{at}"
    for k in range(12):  # copies, and texts that share much but not enough
        texts[at] = texts[k * 4].upper() if k % 2 else "  " + texts[k * 4]
        texts[at + 1] = " ".join(texts[k * 4].split()[:30] + word(30))
        at += 2
    return texts | {900: "one two", 901: "One  two", 902: None, 903: "", 904: "one two three", 905: "a b c d e"}


def linked_pairs(texts):
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    return [(a, b) for a, b in combinations(sorted(texts), 2) if words[a] == words[b] or sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def frame(spark, texts, families=None):
    rows = [(i, t, (families or {}).get(i), "old") for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, family string, split string")


def test_components_of_texts_equal_brute_force(spark):
    texts = corpus()
    expected = dict(brute(linked_pairs(texts)))
    linked = link_texts(frame(spark, texts))
    found = {r["id"]: r["component"] for r in linked.labelled().collect()}
    assert found == {i: expected.get(i, i) for i in texts}
    assert linked.near.count() < len(linked_pairs(texts))  # what connects, not all pairs


def test_no_link_crosses_the_split(spark):
    texts = corpus()
    docs = frame(spark, texts)
    out = leak_free_split(docs, share=0.4)
    assert sorted(out.columns) == ["component", "doc_id", "family", "split", "text"]
    side = {r["doc_id"]: r["split"] for r in out.collect()}
    assert set(side) == set(texts) and set(side.values()) == {"train", "validation"}
    assert all(side[a] == side[b] for a, b in linked_pairs(texts))


def test_neither_does_a_family(spark):
    texts = corpus()
    families = {i: f"f{i % 17}" for i in range(24, 40)} | {900: "f3", 905: "f5"}
    out = leak_free_split(frame(spark, texts, families), family="family", share=0.3).collect()
    side, component = {r["doc_id"]: r["split"] for r in out}, {r["doc_id"]: r["component"] for r in out}
    more = [(a, b) for a, b in combinations(sorted(families), 2) if families[a] == families[b]]
    expected = dict(brute(linked_pairs(texts) + more))
    # a family's component is named by its smallest representative
    groups = {}
    for i in texts:
        groups.setdefault(expected.get(i, i), set()).add(component[i])
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
    assert all(side[a] == side[b] for a, b in linked_pairs(texts) + more)


def test_one_component_cannot_be_split(spark):
    with pytest.raises(ValueError, match="two families"):
        leak_free_split(frame(spark, {1: "same", 2: "same"}))


def test_a_filter_changes_no_row(spark):
    rng = np.random.default_rng(5)
    texts = {k: " ".join(f"w{x}" for x in rng.integers(0, 12, 30)) for k in range(60)}
    docs, held = frame(spark, texts), frame(spark, {k: texts[k] + " more" for k in range(0, 60, 20)} | {99: None})
    found = [sorted(map(tuple, protected_windows(docs, held, 3, most_bits=m).collect())) for m in (1 << 23, 0)]
    assert found[0] == found[1] and len(found[0]) > 100
    assert protected_windows(docs, held.limit(0), 3).collect() == []


def test_filters_hold_all_their_values_and_few_others(spark):
    values = spark.range(5000).select(F.xxhash64("id").alias("g"))
    bits, size = bloom(values, "g")
    other = spark.range(5000, 25000).select(F.xxhash64("id").alias("g"))
    share = lambda df: df.crossJoin(bits).agg(F.avg(passes(F.col("g"), F.col("bits"), size).cast("int"))).first()[0]
    assert size == 65536 and share(values) == 1.0 and share(other) < 0.02
    assert bloom(values, "g", 1 << 15) is None


def test_windows_shared_with_protected_texts(spark):
    held = frame(spark, {1: "a b c d e f g h i j", 2: "too short", 3: None})
    docs = frame(spark, {10: "x A b, c d e f g h", 11: "x a b c d e f g h y", 12: "b c d e f g h i", 13: "too short", 14: None})
    assert sorted(r["id"] for r in shared_windows(docs, held).collect()) == [11, 12]


def sets_of(texts):
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    return {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}


def test_bitmaps_never_count_more_than_differs(spark):
    rng = np.random.default_rng(9)
    rows, pairs = [], []
    for k, n in enumerate([1, 2, 31, 32, 33, 60, 700, 1024, 3000]):
        one = rng.integers(-(2**63), 2**63 - 1, n)
        for j, kept in enumerate((n, n - n // 50, n - n // 5)):
            other = np.concatenate([one[:kept], rng.integers(-(2**63), 2**63 - 1, n // 6 if j else 0)])
            rows += [(10 * k, one.tolist()), (10 * k + j + 1, other.tolist())]
            pairs.append((10 * k, 10 * k + j + 1, len(set(one.tolist()) ^ set(other.tolist()))))
    sets = spark.createDataFrame(rows, "id long, s array<long>").dropDuplicates(["id"]).coalesce(2)
    found = bitmaps(sets, at_once=500)
    assert {r["id"]: r["n"] for r in found.collect()} == {i: len(s) for i, s in rows}
    end = lambda i, p: found.select(F.col("id").alias(i), F.col("p").alias(p))
    out = spark.createDataFrame(pairs, "a long, b long, d long").join(end("a", "x"), "a").join(end("b", "y"), "b").select("d", links._apart(F.col("x"), F.col("y")).alias("m"))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(pairs) and all(m <= d and (d - m) % 2 == 0 and 2 * m >= d for d, m in got)


def test_whole_sets_are_made_only_of_pairs_that_may_be_similar(spark, monkeypatch):
    word = lambda k, n: [f"{k}w{x}" for x in range(n)]
    texts = {k: " ".join(word("same", 60) + word(k, 60)) for k in range(20)} | {50: " ".join([*word(3, 60), "one"]), 51: " ".join([*word(3, 60), "two"])}
    seen, plain = [], links.similar
    monkeypatch.setattr(links, "similar", lambda pairs, sets, percent: seen.append((pairs.count(), sets.count())) or plain(pairs, sets, percent))
    linked = link_texts(frame(spark, texts))
    assert sorted(map(tuple, linked.near.collect())) == [(50, 51)] and [x for x in seen if x[0]] == [(1, 2)]


def test_texts_do_not_meet_on_what_some_others_hold_too(spark, monkeypatch):
    monkeypatch.setattr(links, "SAMPLED", 1)
    word = lambda k, n: [f"{k}w{x}" for x in range(n)]
    texts = {k: " ".join(word(f"passage{k % 4}", 40) + word(k, 60)) for k in range(24)}  # six texts a passage
    assert links.shared_elements(frame(spark, texts)).rare.count() == 0  # their own windows come first
    texts |= {50: texts[3] + " more", 51: texts[4]}
    assert sorted(map(tuple, link_texts(frame(spark, texts)).near.collect())) == [(3, 50)]


@pytest.mark.parametrize(("sampled", "marked", "levels"), [(1, 1 << 18, 1000), (1, 40, 1000), (1, 0, 3), (2, 1 << 18, 2)])
def test_which_windows_are_marked_changes_no_link(spark, monkeypatch, sampled, marked, levels):
    for name, value in (("SAMPLED", sampled), ("MARKED", marked), ("LEVELS", levels)):
        monkeypatch.setattr(links, name, value)
    texts = corpus()
    expected = dict(brute(linked_pairs(texts)))
    found = {r["id"]: r["component"] for r in link_texts(frame(spark, texts)).labelled().collect()}
    assert found == {i: expected.get(i, i) for i in texts}


def test_copies_of_a_text_mark_nothing(spark, monkeypatch):
    monkeypatch.setattr(links, "SAMPLED", 1)
    docs = frame(spark, {k: "a b c d e f g h" for k in range(30)}).select(F.col("doc_id").alias("id"), "text")
    assert not any(links.frequent(docs, 5).first()["bits"])


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_all_pairs_by_either_way_of_frequent_elements(spark, monkeypatch, few):
    monkeypatch.setattr(links, "BROADCAST_IDS", few)
    monkeypatch.setattr(links, "_is_frequent", lambda g: F.pmod(g, F.lit(2)) == 0)  # any order finds the same pairs
    texts = corpus()
    sets = sets_of(texts)
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    reps = sorted(i for s, i in first.items() if s)
    want = [(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a, b in combinations(reps, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    docs = frame(spark, texts)
    assert sorted(map(tuple, similar_pairs(docs).collect())) == want and len(want) > 20
    assert sorted(map(tuple, similar_pairs(docs.unionAll(docs)).collect())) == want


def test_whole_texts_leave_little_on_disk(spark, monkeypatch):
    written, plain = [], links.stored

    def stored(df):
        out = plain(df)
        written.append(sum(Path(f.removeprefix("file://")).stat().st_size for f in out.inputFiles()))
        return out

    monkeypatch.setattr(links, "stored", stored)
    texts = {k: " ".join(f"{k}w{x}" for x in range(2000)) for k in range(100)}
    assert link_texts(frame(spark, texts)).near.count() == 0
    assert sum(written) < 100 * 2000  # an eighth of the elements of the quarters that are looked at


def odd_texts():
    rng = np.random.default_rng(11)
    pick = lambda x, n: "".join(rng.choice(x, n))
    spaces = [*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0", "\u1680", "\u2003", "\u200a", "\u200b", "\u2028", "\u202f", "\u205f", "\u3000", "", "", ""]
    texts = ["".join(pick([*"abÄéß漢\U0001f600İ"], 1) + pick(spaces, 1) for _ in range(rng.integers(0, 60))) for _ in range(150)]
    return dict(enumerate([*texts, None, "", " ", "\u3000", "a b c d e", " A  b\tc d e ", "x" * 500 + " y", "a b", "B a"]))


@pytest.mark.parametrize("at_once", [1 << 20, 64, 1])
def test_windows_are_those_of_the_expressions(spark, at_once):
    docs = frame(spark, odd_texts()).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).repartition(3)
    text = F.col("text")
    assert sorted(map(tuple, with_word_count(docs, "text", "n", at_once).collect())) == sorted(map(tuple, docs.select("id", T.word_count(text)).collect()))
    made = {r["id"]: r["s"] for r in Sets(3, at_once).whole(docs).collect()}
    plain = {r["id"]: (set(r["w"]), r["t"]) for r in docs.select("id", T.word_windows(text, 3).alias("w"), T.normalised(text).alias("t")).collect()}
    alike = {(g, h) for i in plain for g, h in zip(made[i], made[i], strict=True)}
    assert {i: len(s) for i, s in made.items()} == {i: len(w) for i, (w, _) in plain.items()} and len(alike) == len(set().union(*(w for w, _ in plain.values())))
    found = {}
    for i, g in windows(docs, 3, at_once=at_once).collect():
        found.setdefault(i, []).append(g)
    assert all(sorted(s) == sorted(found.get(i, [])) for i, s in made.items())
    keys = {r["id"]: (r["k1"], r["k2"]) for r in Sets(3, at_once).keys(docs).collect()}
    same = lambda x: sorted(sorted(g) for g in ([i for i in x if x[i] == v] for v in set(x.values())))
    assert same(keys) == same({i: frozenset(w) or t for i, (w, t) in plain.items()})


def test_short_texts_equal_to_protected_ones_are_contaminated(spark):
    docs = frame(spark, {1: "too short", 2: " Too\tSHORT ", 3: "short too", 4: "too short too", 5: "a b c d e f g h i", 6: None, 7: "one"})
    held = frame(spark, {1: "too  short", 2: "x a b c d e f g h"})
    verdict = lambda h: {r["id"]: r["verdict"] for r in exclusions(docs, h).collect()}
    assert {i for i, v in verdict(held).items() if v == "contaminated"} == {1, 2, 5}
    assert {i for i, v in verdict(held.limit(0)).items() if v == "contaminated"} == set() and verdict(held.limit(0))[2] == "equal"
