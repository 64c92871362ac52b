"""Centroid clustering against plain Lloyd in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from corpusmill.llm import lloyd
from corpusmill.llm.covertree import Centroids, assign, cover_tree

SCHEMA = "vec_id long, embedding array<float>, cluster int, q string, distance int"


def brute(rows, k=8, rounds=10, d=64):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(cents)), key=lambda c: (far(v, cents[c]), c))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v), []).append(v)
        cents = [[sum(x) // len(own[c]) for x in zip(*own[c], strict=True)] if c in own else cents[c] for c in range(len(cents))]
    found = [(i, c := nearest(v), far(v, cents[c])) for i, v in kept]
    inside = {c: sum(x[2] for x in found if x[1] == c) for c in {x[1] for x in found}}
    return sorted(((i, c, x, inside[c], sum(inside.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, x in found), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "q", 2) for i, v in rows], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def vectors(n, seed=0, spread=0.1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, 64))
    return [(i, (middle[i % 12] + spread * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("spread", "block"), [(0.05, 64), (1.0, 37), (0.3, 2048)])
def test_clusters_equal_plain_lloyd(spark, spread, block):
    rows = vectors(300, 3, spread)
    assert rows_of(lloyd.clusters(frame(spark, rows).repartition(3), block=block)) == brute(rows)


def test_awkward_vectors(spark):
    one = vectors(1)[0][1]
    odd = [(1000, None), (1001, []), (1002, one[:63]), (1003, [*one, 1.0]), (1004, [None, *one[1:]]), (1005, [float("nan"), *one[1:]]), (1006, [float("-inf"), *one[1:]]), (1007, [0.0] * 64), (None, one), (5, one), (5, one)]
    rows = vectors(40, 1) + odd + [(2000 + k, [0.25] * 64) for k in range(150)]
    assert rows_of(lloyd.clusters(frame(spark, rows).repartition(4), block=50)) == brute(rows)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = vectors(3)
    assert rows_of(lloyd.clusters(frame(spark, rows))) == brute(rows)
    same = [(i, [0.5] * 64) for i in range(20)]
    assert rows_of(lloyd.clusters(frame(spark, same))) == brute(same)
    assert lloyd.clusters(frame(spark, [])).collect() == []
    assert lloyd.clusters(frame(spark, [(1, None)])).collect() == []


def test_components_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="a component of a vector is beyond"):
        lloyd.clusters(frame(spark, [(1, [3e30] * 64), (2, [1.0] * 64)])).collect()


def test_a_cover_tree_covers_separates_and_nests():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-50, 50, (200, 5)), np.repeat(rng.integers(-50, 50, (3, 5)), 40, axis=0), rng.integers(0, 2, (60, 5))])
    tree = cover_tree(x, 4)
    y = x[tree.order]
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    for k in range(len(tree.begin)):
        rows = y[tree.begin[k] : tree.end[k]]
        away = np.sqrt(((rows - y[tree.centre[k]]) ** 2).sum(axis=1))
        assert tree.begin[k] <= tree.centre[k] < tree.end[k] and away.max() <= tree.radius[k]
        if tree.children[k]:
            kids = np.arange(tree.first[k], tree.first[k] + tree.children[k])
            assert tree.begin[kids].tolist() == [tree.begin[k], *tree.end[kids][:-1].tolist()] and tree.end[kids[-1]] == tree.end[k]
            half = 2.0 ** (np.ceil(np.log2(away.max())) - 1)
            c = y[tree.centre[kids]]
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))
            assert tree.centre[kids[0]] == tree.centre[k] and (apart[~np.eye(len(c), dtype=bool)] > half).all() and (tree.radius[kids] <= half + 1e-3).all()
        else:
            assert len(rows) <= 4 or away.max() <= 1e-3


@pytest.mark.parametrize("most", [3, 1000, 1 << 26])
def test_pairs_descend_to_the_nearest_centroid_with_ties(most):
    rng = np.random.default_rng(most)
    for d in (1, 2, 8):
        for k in (1, 2, 9, 40):
            x = rng.integers(-most, most, (400, d))
            c = rng.integers(-most, most, (k, d))
            c[k // 2] = c[0]
            tree = cover_tree(x)
            label, _ = assign(x[tree.order], tree, Centroids(c))
            away = ((x[tree.order][:, None] - c[None]) ** 2).sum(axis=2)
            assert label.tolist() == away.argmin(axis=1).tolist()


def test_whole_nodes_are_assigned_without_looking_at_their_rows():
    rng = np.random.default_rng(8)
    x = np.repeat(rng.integers(-5000, 5000, (6, 64)), 300, axis=0) + rng.integers(-5, 5, (1800, 64))
    tree = cover_tree(x)
    _, computed = assign(x[tree.order], tree, Centroids(x[::300]))
    assert computed < len(x) * 6 / 20
