import random
import re

import pytest

from ledgermill.llm import rules, secret_scan

KEYWORDS = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def repeated(words, k=5):
    runs = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    return len({i + j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(k)})


def test_measures_equal_plain_counts(texts):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b c d e a b c d e a b"), (6, "x # $$ |\nx # $$ |\n\ny"), (6, "dup")]
    rows += [(10 + i, " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(20)]
    found = {(r["doc_id"], r["text"]): r for r in rules.apply_rules(texts(rows)).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        r, w = found[i, text], re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeated(w)
        assert r["row"] == "x" and r["kept"] == (not r["failed"])
    assert rules.apply_rules(texts([])).count() == 0


def plain_spans(text):
    found = []
    for m in re.finditer(KEYWORDS, text or "", re.A):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return sorted(found)


def test_base_spans(texts):
    parts = ["Token=", "passwd", ': "', "abcd1234", "x", "é", "\U0001f600", " ", "AKIA", "ABCDEFGHIJ123456", "0123456789abcdef" * 2, "api_key", "=", "'"]
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, "token=passwd:longvalue123")] + [(i, "".join(rng.choices(parts, k=rng.randrange(25)))) for i in range(10, 300)]
    found = {r["doc_id"]: r["spans"] for r in secret_scan.find_secrets(texts(rows)).collect()}
    for i, text in rows:
        assert [(s["start"], s["rank"], s["end"]) for s in found[i] if s["kind"] != "random"] == plain_spans(text), text
    assert secret_scan.find_secrets(texts([])).count() == 0


def test_random_strings_are_told_from_words(texts):
    rng = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choices(alphabet, k=rng.choice([44, 64, 88]))) for _ in range(60)]
    names = ["".join(rng.choices(["the", "ation", "ing", "er", "Over", "con", "data"], k=8)) for _ in range(60)]
    names += ["z" * 40, "/usr/local/share/applications/desktop", "aaaaaaaaaabbbbbbbbbbccccccccccdddddddddd"]
    rows = [(i, f"see {k} there") for i, k in enumerate(keys)] + [(1000 + i, f"see {k} there") for i, k in enumerate(names)]
    found = secret_scan.find_secrets(texts(rows)).collect()
    found = [r["doc_id"] for r in found if any(s["kind"] == "random" for s in r["spans"])]
    assert sum(i < 1000 for i in found) >= 55
    assert sum(i >= 1000 for i in found) == 0


def test_random_strings_of_every_encoding_and_length(texts):
    rng = random.Random(11)
    rows, of = [], {}
    for name, _, alphabet, _ in secret_scan.ENCODINGS:
        if name in ("decimal", "hex"):  # ten symbols say little; long hex strings are a base kind
            continue
        for length in (40, 64, 96, 128, 256):
            for _ in range(20):
                of[len(rows)] = (name, length)
                rows.append((len(rows), "key " + "".join(rng.choices(alphabet, k=length)) + " end"))
    words = ["the", "ation", "ing", "er", "Over", "con", "data", "file", "2024", "12", "section"]
    plain = [(len(rows) + i, "see " + "".join(rng.choices(words, k=rng.choice([6, 9, 14, 30]))) + " now") for i in range(400)]
    plain += [(9000, "x" * 500_000), (9001, "ab" * 100), (9002, None)]
    found = secret_scan.find_secrets(texts(rows + plain)).collect()
    caught = [of.get(r["doc_id"]) for r in found if any(s["kind"] == "random" for s in r["spans"])]
    for name, length in set(of.values()):
        # 32 symbols in one case differ little from words: only longer strings are evidence enough
        least = 0 if name.startswith("base32") and length < 96 else 10 if length == 40 else 17
        assert caught.count((name, length)) >= least, (name, length, caught.count((name, length)))
    assert caught.count(None) <= 0.02 * len(caught)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 65])
def test_running_sums(spark, n):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(list(range(n)),)], "a array<int>").select(F.transform("a", lambda x: F.coalesce(x, F.lit(0))).alias("a"))
    assert frame.select(secret_scan._running(F.col("a"))).first()[0] == [sum(range(i + 1)) for i in range(n)]
