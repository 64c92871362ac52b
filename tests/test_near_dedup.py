"""Pairs of representatives and their membership together give every link."""

from itertools import combinations

import numpy as np

from corpusmill import catalog


def test_pairs_and_members_give_all_links(spark, tmp_path):
    base = " ".join(np.random.default_rng(1).choice([f"w{i}" for i in range(300)], 80))
    near = base.replace(base.split()[40], "changed", 1)
    only = " ".join(f"x{i}" for i in range(30))
    texts = {1: base, 2: base, 3: base, 4: near, 5: near, 6: only, 7: only, 8: " ".join(f"y{i}" for i in range(30)), 9: "too short"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = {(r["a"], r["b"]) for r in catalog.queries()["cmp_near_dedup"](spark, str(tmp_path)).collect()}
    rows = catalog.queries()["cmp_near_dedup_members"](spark, str(tmp_path)).collect()
    rep = {r["doc_id"]: r["representative"] for r in rows}
    assert len(rows) == 8 and {r["doc_id"]: r["copies"] for r in rows} == {1: 3, 2: 3, 3: 3, 4: 2, 5: 2, 6: 2, 7: 2, 8: 1}
    links = {(a, b) for a, b in combinations(sorted(rep), 2) if rep[a] == rep[b] or (rep[a], rep[b]) in pairs or (rep[b], rep[a]) in pairs}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    assert links == {(a, b) for a, b in combinations(sorted(texts), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
