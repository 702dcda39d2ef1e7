import base64
import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken

from ledgermill.llm import byte_bpe
from ledgermill.llm.bpe_queries import VOCABULARY, op13_byte_bpe

ALPHABETS = ["ab", "aA", "eé", "abcdefghijklmnop", "the inoratione ", "0123456789", "=-_#'", "日本語のテキ", "\n \t\r  ", "аеинот", "👩‍👧é́", "'s 'll d"]


def peer(coder):
    return tiktoken.Encoding(
        "peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.merges.ranks, special_tokens={}
    ).encode_ordinary


def coded(coder, text):
    return [i for part in coder.ids(text) for i in part]


@pytest.fixture(scope="module", params=[VOCABULARY, "byte_bpe_50k.tiktoken"])
def coder(request):
    return byte_bpe.Coder(byte_bpe.read_ranks(public_tokenizers.path(request.param)), public_tokenizers.PATTERN)


def test_ids_equal_the_merges(coder):
    encode, rng = peer(coder), random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randrange(1, 50)))
        ids = coded(coder, text)
        assert ids == encode(text) and coder.decode(ids) == text.encode()


def test_every_token_is_merged_from_two(coder):
    merges = coder.merges
    assert set(merges.parts) == {r for r, t in merges.tokens.items() if len(t) > 1}
    assert all(merges.tokens[a] + merges.tokens[b] == merges.tokens[r] for r, (a, b) in merges.parts.items())


def test_a_vocabulary_with_a_token_that_no_merge_reaches():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"xyz", b"abc", b"bc", b"bcd"]
    raw = b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens))
    coder = byte_bpe.Coder(raw, public_tokenizers.PATTERN)
    encode, rng = peer(coder), random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice("abcdxyz ") for _ in range(rng.randrange(9)))
        assert coded(coder, text) == encode(text)
    with pytest.raises(ValueError):
        byte_bpe.Merges(b"YQ== 0")


def test_long_pieces_and_texts_take_linear_time(coder):
    rng, encode = random.Random(3), peer(coder)
    took = []
    for n in (20_000, 200_000):
        text = "".join(rng.choice("abcdefgh") for _ in range(n))
        start = time.process_time()
        ids = coded(coder, text)
        took.append(time.process_time() - start)
        assert coder.decode(ids) == text.encode()
        if n == 20_000:
            assert ids == encode(text)
    assert took[1] < 30 * max(took[0], 0.01)
    text = "".join(rng.choice(["word ", "\n\n ", "Zahl 12,5 ", "   x"]) for _ in range(100_000))
    parts = list(coder.ids(text))
    assert len(parts) > 3 and [i for p in parts for i in p] == encode(text)


def test_edge_rows(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    rows = [(1, None, "a"), (2, "", "b"), (None, "hello", "c"), (3, "hello", "d"), (3, "hello", "e"), (4, "x" * 300_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = byte_bpe.digests(docs, ranks, public_tokenizers.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r["doc_id"] or 0, r["n_tokens"] == 0) for r in found) == [(0, False), (1, True), (2, True), (3, False), (3, False), (4, False)]
    assert all((r["ids_sha256"] == empty) == (r["n_tokens"] == 0) for r in found)
    ids = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    back = byte_bpe.decode(ids, ranks).collect()
    assert sorted((r["doc_id"] or 0, r["data"].decode()) for r in back) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert byte_bpe.digests(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_query_equals_the_merges(spark):
    folder = "/root/testdata/sf0.001"
    coder = byte_bpe.coder(byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)
    encode = peer(coder)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op13_byte_bpe(spark, folder).collect():
        ids = encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
