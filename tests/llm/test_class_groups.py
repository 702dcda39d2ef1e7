"""The model tells a class by its group, and frequent words are encoded once for all tasks."""

import numpy as np
import pyarrow as pa

from ledgermill.llm import attention, lm_scoring
from ledgermill.llm.words import BLANK_WORDS, Words

CLASSES = 40  # three groups, the last one part empty


def run(rng):
    slot, text, _ = attention.layout(np.array([20, 7, 16, 50]))
    inputs, classes = np.zeros(len(text), np.int64), np.full(len(text), -1)
    inputs[slot], classes[slot] = rng.integers(0, 9, len(slot)), rng.integers(0, CLASSES, len(slot))
    return inputs, text, classes


def test_gradient_through_groups():
    rng = np.random.default_rng(2)
    inputs, text, classes = run(rng)
    m = {k: v.astype(np.float64) for k, v in attention._start(1, 9, attention.WIDTH, CLASSES).items()}
    wi, wt, wy = attention._windows(inputs, 0), attention._windows(text, -1), attention._windows(classes, -1)[:, attention.STRIDE :]

    def loss():
        z = attention._forward(m, wi, wt)["z"]
        return -np.take_along_axis(z, np.maximum(wy, 0)[..., None], -1)[..., 0][wy >= 0].mean()

    grad = attention._gradient(m, wi, wt, wy)
    for name in ("group", "group_bias", "out", "bias", "embed", "query", "key", "value", "own", "near"):
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in m[name].shape)
            kept, sides = m[name][at], []
            for move in (1e-5, -1e-5):
                m[name][at] = kept + move
                sides.append(loss())
            m[name][at] = kept
            assert abs((sides[0] - sides[1]) / 2e-5 - grad[name][at]) < 1e-5, name


def test_probabilities_of_classes_sum_to_one():
    inputs, text, _ = run(np.random.default_rng(3))
    m = attention._start(1, 9, attention.WIDTH, CLASSES)
    every = [attention.log10_classes(m, inputs, text, np.full(len(text), c)) for c in range(CLASSES)]
    assert np.allclose((10 ** np.array(every)).sum(axis=0), 1, atol=1e-5)


def test_known_words_have_the_tokenizers_ids(spark):
    with open(lm_scoring.TOKENIZER, "rb") as f:
        proto = f.read()
    words = Words(pa.array(["alpha beta alpha", None, "", "gamma unheard, beta ÄÖ"]), BLANK_WORDS)
    codes, _, first = lm_scoring._distinct(words)
    counted = [(w, c, 1) for w, c in zip(lm_scoring._spelled(words, first).to_pylist(), codes.view(np.int64).tolist())]
    frame = spark.createDataFrame(counted, "word string, h long, c long")
    plain = lm_scoring._Subwords(proto).of(words)
    for some in (frame, frame.filter("word in ('alpha', 'beta')"), frame.limit(0)):
        found = lm_scoring._Subwords(proto, lm_scoring._known(some, proto)).of(words)
        assert all(np.array_equal(a, b) for a, b in zip(plain[:3], found[:3]))
        assert (found[3] >= 0).sum() == {0: 0, 2: 4}.get(some.count(), len(words))
