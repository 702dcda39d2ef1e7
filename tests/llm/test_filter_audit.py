import random
import re
from itertools import permutations
from math import factorial

import pytest

from ledgermill.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int, mask string, n string"


def test_lattice_counts_every_order():
    for n in range(1, 7):
        edges = {(s, f): w for s, f, w in filter_audit.lattice(n)}
        assert len(edges) == n * 2 ** (n - 1)
        used = dict.fromkeys(edges, 0)
        for order in permutations(range(n)):
            state = 0
            for f in order:
                used[state, f] += 1
                state |= 1 << f
        assert used == edges and sum(w for (s, _), w in edges.items() if not s) == factorial(n)


def plain(docs, labels):
    """Every order applied row by row."""
    firsts = {}
    for i, t, *_ in docs:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    rows = []
    for i, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > firsts[t],
        }
        good = i is not None and any(d == i and q == 1 for d, q, *_ in labels)
        toxic = i is not None and any(d == i and x == 1 for d, _, x, *_ in labels)
        rows.append((lang or "", fails, good, toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                every = [r for r in rows if r[0] == part and r[1][f]]
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(every) - len(gone), sum(sum(r[1].values()) == 1 for r in every),
                    sum(r[2] for r in gone), sum(r[3] for r in gone), f,
                ]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def sample(seed):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "one", "A B C", "x " * 300, "word#", "long " + "wordy" * 30000, " a b ", "a  b", "É é"]
    texts += [" ".join(rng.choice(["Ab", "c", "d$", f"w{rng.randrange(400)}"]) for _ in range(rng.choice([5, 250]))) for _ in range(12)]
    texts += [" ".join(f"w{k}" for k in range(220))] * 3
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "de", None, ""]), "m", "d", 1) for _ in range(150)]
    docs += [(100 + i, "copy of one", "en", "m", "d", 1) for i in range(60)] + [(7, "copy of one", "de", "m", "d", 1)] * 5
    labels = [(rng.choice([None, *range(120)]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "m", "n") for _ in range(90)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_every_order_applied(spark, seed):
    docs, labels = sample(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, mask string, digest string, n int")
    found = filter_audit.audit(frame, spark.createDataFrame(labels, LABELS)).collect()
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in found} == plain(docs, labels)
    assert len(found) == 600 * len({d[2] or "" for d in docs})


def test_empty_tables(spark, texts):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(texts([]), none).count() == 0
    found = filter_audit.audit(texts([(1, None)]), none).collect()
    assert len(found) == 600 and {r["good_lost"] for r in found} == {0}
