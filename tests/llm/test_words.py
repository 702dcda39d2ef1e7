import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgermill.llm.words import ALNUM_WORDS, BLANK_WORDS, Words, shingles, text_slices

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ9 \t\n.é中\U0001f600", max_size=30)), max_size=8)
RULES = [(BLANK_WORDS, "[^\x20\x09-\x0D]+"), (ALNUM_WORDS, "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@given(TEXT)
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    for table, pattern in RULES:
        words = Words(pa.array(texts, pa.string()), table)
        found = [words.data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends)]
        wanted = [re.findall(pattern, lower(t)) for t in texts]
        assert found == [w for row in wanted for w in row]
        assert np.diff(words.first).tolist() == [len(w) for w in wanted]
        codes = words.codes().tolist()
        assert len(set(zip(found, codes))) == len(set(found)) == len(set(codes))


@given(TEXT, st.integers(1, 5))
@settings(max_examples=100, deadline=None)
def test_shingles_are_runs_of_words(texts, width):
    words = Words(pa.array(texts, pa.string()), BLANK_WORDS)
    hashes, first = shingles(words, width)
    seen = {}
    for i, text in enumerate(texts):
        w = re.findall(RULES[0][1], lower(text))
        runs = [tuple(w[k : k + width]) for k in range(len(w) - width + 1)] or ([tuple(w)] if w else [])
        own = hashes[first[i] : first[i + 1]].tolist()
        assert len(own) == len(runs)
        for run, h in zip(runs, own):
            assert seen.setdefault(run, h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "", "b" * 50, "c"]})
    parts = list(text_slices([batch, batch.slice(0, 0)], limit=11))
    assert [p.num_rows for p in parts] == [3, 1, 1]
