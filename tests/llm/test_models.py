import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgermill.llm import attention, html_blocks, html_text, language, lm_scoring, weak_labels

SYLLABLES = {"en": "th er ing on the of and".split(), "de": "sch ein ung der die und ü".split(), "fr": "eau ou é les des que".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_languages_are_told_apart(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.choice([8, 60, 200])), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    odd = [(900, None, None), (901, "", "en"), (902, "123 -- !!", "en"), (903, "x", None), (903, "x", None), (904, "qzxj " * 300, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = language.fit(docs.filter(language.fold(docs["doc_id"], 4) != 2))
    found = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert sum(found[i]["lang_pred"] == lang for i, _, lang in held) >= 0.95 * len(held)
    assert [found[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert all(found[i]["rejected"] and found[i]["score"] == 0 for i in (900, 901, 902))
    assert found[903]["lang_pred"] in SYLLABLES and found[904]["rejected"]
    assert sum(found[i]["rejected"] for i, _, _ in rows) <= 2
    assert language.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}


def test_language_of_mostly_copies_stays_in_the_model(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 4)
    rng = random.Random(4)
    few = [(prose(rng, "de", 60), "de") for _ in range(2)]
    many = [(prose(rng, "en", 60), "en") for _ in range(40)]
    docs = spark.createDataFrame(few * 2000 + many, "text string, lang string")
    model = language.fit(docs)
    # both texts of the copied language are sampled, and the other's quota of two
    assert model.languages == ["de", "de", "en", "en"]
    assert set(language.fit(docs.filter("lang = 'de'").filter(docs["text"] == few[0][0])).languages) == {"de"}


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    inputs, classes = rng.integers(0, 9, 64), rng.integers(0, 5, 64)
    slot, text, _ = attention.layout(np.array([20, 7, 16]))
    wide = lambda x, fill: np.where(text >= 0, np.resize(x, len(text)), fill)
    inputs, classes = wide(inputs, 0), wide(classes, -1)
    m = {k: v.astype(np.float64) for k, v in attention._start(1, 9, attention.WIDTH, 5).items()}
    wi, wt, wy = attention._windows(inputs, 0), attention._windows(text, -1), attention._windows(classes, -1)[:, attention.STRIDE :]

    def loss():
        z = attention._forward(m, wi, wt)["z"]
        logs = z - np.log(np.exp(z).sum(axis=-1, keepdims=True))
        return -np.take_along_axis(logs, np.maximum(wy, 0)[..., None], -1)[..., 0][wy >= 0].mean()

    grad = attention._gradient(m, wi, wt, wy)
    for name in m:
        at = tuple(rng.integers(0, s) for s in m[name].shape)
        kept = m[name][at]
        m[name][at] = kept + 1e-5
        up = loss()
        m[name][at] = kept - 1e-5
        down = loss()
        m[name][at] = kept
        assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-5, name
    # the fast pass gives the same probabilities, each text as if alone
    fast = {k: v.astype(np.float32) for k, v in m.items()}
    logs = attention.log10_classes(fast, inputs, text, np.maximum(classes, 0))
    assert abs(-logs[text >= 0].mean() * np.log(10) - loss()) < 1e-4
    own = text == 1
    alone = attention.log10_classes(fast, inputs[own.nonzero()[0][0] :][:16], np.where(own, 0, -1)[own.nonzero()[0][0] :][:16], np.maximum(classes, 0)[own.nonzero()[0][0] :][:16])
    assert np.allclose(alone[:7], logs[own], atol=1e-5)


def test_probabilities_of_ids_sum_to_one():
    voc = attention.vocabulary(np.array([50, 0, 3, 900, 7, 0]), classes=3, inputs=4)
    assert set(voc.classes) == {0, 1, 2}
    assert np.allclose(np.bincount(voc.classes, weights=10**voc.within), 1)


def test_scores_of_texts(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, prose(rng, "en", 30)) for i in range(60)] + [(100, None), (101, ""), (102, "Unseen WORDS here"), (None, "the end"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    training = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None]
    c = Counter(w for t in training for w in words(t))
    n, v = sum(c.values()), len(c)
    for hot in (1 << 18, 3):  # with and without words that need the join
        monkeypatch.setattr(lm_scoring, "HOT", hot)
        found = lm_scoring.score_texts(docs).collect()
        assert len(found) == len(rows)
        by = {(r["doc_id"], r["n_tokens"]): r for r in found}
        for i, t in rows:
            r, w = by[i, len(words(t))], words(t)
            assert (r["n_known"], r["train_tokens"]) == (sum(c[x] > 0 for x in w), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
            assert r["score"] < 0
    assert lm_scoring.score_texts(docs.limit(0)).count() == 0


def test_labels_from_votes():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.7
    accuracy, coverage = np.array([0.9, 0.8, 0.7, 0.95]), np.array([0.9, 0.8, 0.9, 0.3])
    right = rng.random((4000, 4)) < accuracy
    votes = np.where(right == truth[:, None], 2, 1) * (rng.random((4000, 4)) < coverage)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_labels.estimate(patterns, counts.astype(float))
    assert abs(model.good - 0.7) < 0.05
    assert ((model.posterior(votes) >= 0.5) == truth).mean() > 0.9


def test_scorer_keeps_clean_texts(texts):
    rng = random.Random(5)
    clean = [(i, prose(rng, "en", 80)) for i in range(150)]
    junk = [(500 + i, " ".join(w + "$$$" for w in prose(rng, "en", 60).split())) for i in range(40)]
    rows = clean + junk + [(900, None), (901, ""), (0, clean[0][1])]
    frame = texts(rows)
    found = {r["doc_id"]: r for r in weak_labels.score(frame, weak_labels.fit(frame)).collect()}
    assert sum(found[i]["kept"] for i, _ in clean) >= 147
    assert sum(found[i]["kept"] for i, _ in junk) <= 2
    assert not found[900]["kept"] and found[901]["score"] == 0
    assert weak_labels.score(texts([]), weak_labels.fit(texts([]))).count() == 0


PAGE = (
    "<html><head><title>No</title><style>p{}</style></head><body class='has-sidebar'><header><a href=/>Site</a></header>"
    "<nav><ul><li><a href=/a>Menu one</a></li></ul></nav><div class='cookie-notice'>We use cookies here.</div>"
    "<article><h1>Head &amp; line</h1><p>First   <b>bold</b>\n part.<br>More<script>var x='</p>';</script><p>Se<i>co</i>nd.</p>"
    "<!-- gone --><form><p>Your mail</p></form><ul><li>Point<li>Other point</ul></article>"
    "<section id='comments'><article><p>I liked it a lot, thank you so much for the text.</p></article></section>"
    "<aside><p>Related things</p></aside><footer>&copy; Me</footer></body></html>"
)


def test_main_text(spark):
    want = "Head & line First bold part. More Second. Point Other point"
    rows = [(1, "u", PAGE, 5), (2, "u", None, 5), (3, "u", "", 5), (3, "u", "", 5), (4, "u", PAGE[: PAGE.index("nd.</p>")], 5), (5, "u", "<p", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row long")
    found = sorted((r["page_id"], r["text"], r["n_chars"], r["row"]) for r in html_text.extract_main_text(pages).collect())
    assert found[0] == (1, want, len(want), 5)
    assert [f[1] for f in found[1:4]] == [""] * 3
    assert found[4][1] == "Head & line First bold part. More Seco" and found[5][1] == ""
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


PARAGRAPH = "<p>The council said on Monday that the bridge would stay open for all traffic until the work is done.</p>"


@pytest.mark.parametrize("page", [
    "<article class='post category-social tag-login'>{}</article>",
    "<div class='content comments-open'><article>{}</article><div class=comments-area><article class=comment><p>I like it a lot.</p></article></div></div>",
    "<main class='share-enabled'>{}</main>",
    "<html><body><form id=f><nav><a href=/>Home</a></nav>{}<footer>Imprint</footer></form></body></html>",
    "<article class=post>{}</article><article class=comment><p>I like it a lot.</p></article>",
    "<article>{}<form><p>Subscribe to the letter of the day now.</p></form></article>",
])
def test_words_in_classes_are_hints(page):
    tree = html_blocks.train(*html_blocks.labelled_table())
    text = " ".join([PARAGRAPH[3:-4]] * 3)
    assert html_text.main_text(page.format(PARAGRAPH * 3), tree) == text


def test_quotes_without_end_leak_no_markup():
    tree = html_blocks.train(*html_blocks.labelled_table())
    for start in ("<p class=\"x>", "<p class='x y>", "<p title=it's>"):
        page = start + PARAGRAPH[3:] + PARAGRAPH + '<a class="k" href="/x">link</a>'
        assert html_text.main_text(page, tree) == " ".join([PARAGRAPH[3:-4]] * 2)
    kept = '<p data-x="a > b" title=\'<b>"x"</b>\'>' + PARAGRAPH[3:]
    assert html_text.main_text(kept, tree) == PARAGRAPH[3:-4]


@pytest.mark.parametrize("part", ["<div>", "<a href='x ", "<p class=\"x>", "<", "<div></p>", "<li>x", "<form><article>"])
def test_time_grows_with_the_page(part):
    import time

    took = []
    for n in (3000, 30_000):
        start = time.process_time()
        html_blocks.blocks(part * n + "x > y </div>")
        took.append(time.process_time() - start)
    assert took[1] < 30 * max(took[0], 0.02)


def test_tree_learns_its_table():
    x, y = html_blocks.labelled_table()
    assert (html_blocks.train(x, y).tell(x) == y).all()


def _mean_score(spark, rows, ids):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["score"] / (r["n_tokens"] + 1) for r in lm_scoring.score_texts(docs).collect()}
    return sum(found[i] for i in ids) / len(ids)


def test_weights_learn_from_every_training_text(spark, monkeypatch):
    """The sample's only text does not fit here; the texts beyond the sample teach alone."""
    rng = random.Random(3)
    ring = "alpha bravo charlie delta echo foxtrot golf hotel".split()
    rows = [(i, " ".join(ring[(s + j) % 8] for j in range(40))) for i, s in enumerate(rng.choices(range(8), k=700))]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2]
    monkeypatch.setattr(lm_scoring, "TRAIN_TEXTS", 1)
    monkeypatch.setattr(lm_scoring, "TRAIN_IDS", 1)
    taught = _mean_score(spark, rows, held)
    monkeypatch.setattr(lm_scoring, "RATES", ())
    assert taught > _mean_score(spark, rows, held) + 0.1


def test_sample_skips_only_the_text_that_does_not_fit(monkeypatch):
    import pickle

    import pyarrow as pa

    with open(lm_scoring.TOKENIZER, "rb") as f:
        proto = f.read()
    voc = attention.vocabulary(np.ones(32000, np.int64))
    monkeypatch.setattr(lm_scoring, "TRAIN_IDS", 50)
    train = lm_scoring._train(proto, voc)
    batch = lambda *t: [pa.RecordBatch.from_arrays([pa.array(t), pa.array(range(len(t)), pa.int64())], ["text", "k"])]
    short, other, long = "one two three", "four five six", "word " * 500
    found, want = [pickle.loads(next(train(batch(*t)))["weights"][0].as_py()) for t in ((short, long, other), (short, other))]
    assert all(np.array_equal(found[k], want[k]) for k in want)


def test_every_id_has_an_input_row():
    assert len(set(attention.vocabulary(np.ones(9000, np.int64)).inputs.tolist())) == 9000
