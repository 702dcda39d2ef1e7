import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgermill.llm import near_dups
from ledgermill.llm.components import components


def shingle_set(text, width):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute(rows, width, threshold=80):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= threshold * len(s | t):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted((i, len(s), root(i) if i is not None else None) for (i, _), (_, s) in zip(rows, sets))


def near_copies(seed, n_bases=6, copies=12):
    rng = random.Random(seed)
    rows, passage = [], [f"p{k}" for k in range(40)]
    for b in range(n_bases):
        base = [f"b{b}w{rng.randrange(500)}" for _ in range(rng.choice([3, 30, 90, 300]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.4:
                text += passage
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return [(100 + i, t) for i, t in enumerate(rows)]


def answer(frame, width):
    found = near_dups.near_duplicates(frame, width=width).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found)


def test_components_equal_brute_force(texts, monkeypatch):
    # few pivots, so that open lists need several rounds
    monkeypatch.setattr(near_dups, "PIVOTS", 2)
    for seed, width in ((1, 4), (2, 5)):
        rows = near_copies(seed)
        assert answer(texts(rows), width) == brute(rows, width)


def test_edge_rows(texts, spark):
    rows = [(5, None), (4, ""), (3, " \n"), (9, "One two"), (8, "one TWO"), (7, "a b c d e f g"), (7, "a b c d e f g"), (2, "two one")]
    assert answer(texts(rows), 4) == brute(rows, 4)
    assert answer(texts([]), 4) == []
    kept = near_dups.keep_one(texts(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 7, 8]
    assert kept.columns == texts(rows).columns
    # an id with several texts links what they link; a missing id links nothing
    odd = [(1, "x y z x1"), (2, "x y z x1"), (2, "k l m n"), (3, "k l m n"), (None, "k l m n")]
    found = near_dups.near_duplicates(texts(odd), width=4).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in found) == [(0, None), (1, 1), (2, 1), (2, 1), (3, 1)]
    assert sorted((r["doc_id"] or 0) for r in near_dups.keep_one(texts(odd), width=4).collect()) == [0, 1]


def test_sketch_bound():
    assert near_dups.shared_at_least(10) == 8
    assert near_dups.shared_at_least(51) == 41
    assert near_dups.shared_at_least(1000) == 32


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=20))
@settings(max_examples=8, deadline=None)
def test_components(spark, edges):
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in found} == label and len(found) == len(label)
