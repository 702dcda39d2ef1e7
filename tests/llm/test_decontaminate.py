import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgermill.llm import decontaminate
from ledgermill.llm.fm_index import FMIndex, suffix_array


@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 5), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_index_finds_all_places(text, pattern):
    index = FMIndex(np.array(text), 6, sample=4)
    low, high = index.search(np.array([pattern]))
    found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert found == [i for i in range(len(text)) if text[i : i + len(pattern)] == pattern]


@given(st.lists(st.integers(1, 3), max_size=50))
@settings(max_examples=100, deadline=None)
def test_suffix_order(text):
    text = text + [0]
    assert suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def words(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, width=10):
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            m = min(width, len(b))
            for win in {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if m else ():
                for i in range(len(w) - m + 1):
                    if tuple(w[i : i + m]) == win:
                        hit.update(range(i, i + m))
                        found.add(item)
        out.append((doc, len(w), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=str)


PASSAGE = "The quick, brown fox; jumps over the lazy dog and THEN sleeps (all) day."
ITEMS = [(1, PASSAGE), (2, "lazy dog"), (3, None), (4, "..."), (5, PASSAGE + " Or so they say."), (None, "all day"), (6, "café")]
ROWS = [
    (10, "Start. " + PASSAGE + " End."), (11, "over the lazy dog and then"), (12, None), (13, ""), (14, "!!"),
    (15, "nothing here"), (15, "nothing here"), (16, (PASSAGE + " x ") * 3), (17, "CAFÉ café all day"),
    (18, "quick brown fox jumps over the lazy dog and then"),
]


def test_hits_equal_brute_force(texts, spark, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (1 << 20, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        found = decontaminate.benchmark_hits(texts(ROWS), bench).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found), key=str) == brute(ROWS, ITEMS)
        for r in found:
            data = (r["text"] or "").encode()
            assert sum(len(words(data[a:b].decode())) for a, b in r["spans"]) == r["n_hit"]
    assert found[0]["row"] == "x" and found[0]["score"] == 1


def test_removal_and_empty_tables(texts, spark):
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in decontaminate.benchmark_hits(texts(ROWS), bench, remove=True).collect()}
    assert cut[10] == "Start. . End." and cut[12] is None and cut[15] == "nothing here"
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r["n_hit"] == 0 for r in decontaminate.benchmark_hits(texts(ROWS), none).collect())
    assert decontaminate.benchmark_hits(texts([]), bench).count() == 0
