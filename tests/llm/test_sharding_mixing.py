import hashlib
import math
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from ledgermill.llm import mixing, sharding

ROWS = [(i, "é" * (i % 50)) for i in range(300)] + [(7, "same")] * 40 + [(None, None), (None, ""), (5, "z" * 3000)]


def test_shards_are_contiguous_and_even(texts):
    found = sharding.contiguous_shards(texts(ROWS), shards=9).collect()
    assert len(found) == len(ROWS)
    size = lambda t: len((t or "").encode()) + 16
    per, slots = Counter(), {}
    for r in found:
        assert r["size"] == size(r["text"]) and r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
        per[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append((r["slot"], r["doc_id"] if r["doc_id"] is not None else -1))
    mean = sum(per.values()) / 9
    assert all(abs(b - mean) <= max(size(t) for _, t in ROWS) for b in per.values())
    order = []
    for shard in sorted(slots):
        assert sorted(s for s, _ in slots[shard]) == list(range(len(slots[shard])))
        order += [i for _, i in sorted(slots[shard])]
    assert order == sorted(order)
    assert found[0]["row"] == "x" and found[0]["score"] == 1


def test_shards_of_few_rows(texts):
    assert sharding.contiguous_shards(texts([])).count() == 0
    assert sharding.contiguous_shards(texts([(1, "a")]), keep=False).select("shard", "slot").collect() == [(0, 0)]


def test_poisson_cuts():
    rng = random.Random(3)
    for rate in (0.0, 0.2, 1.0, 7.5, 900.0):
        cuts = mixing.poisson_cuts(rate)
        draws = [sum(c <= (u := rng.randrange(2**52)) for c in cuts) for _ in range(3000 if rate < 100 else 300)]
        mean = sum(draws) / len(draws)
        assert abs(mean - rate) <= 5 * math.sqrt(rate / len(draws)) + 1e-9
    assert mixing.poisson_cuts(0.0) == []


def test_copies_follow_the_inverted_distribution(spark):
    rows = [(i, "t" * (1 + i % 5), ("big", "small", None)[min(2, i % 7)], "k") for i in range(400)] + [(9, None, "big", "k")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, place string")
    weights = spark.createDataFrame([("big", 1.0), (None, 3.0)], "source string, weight double")
    rates = mixing.source_rates(docs, weights).cache()
    of = {r["source"]: r["rate"] for r in rates.collect()}
    assert of["small"] == 0
    found = mixing.mix(docs, rates, seed=5).collect()
    assert [r["order_key"] for r in found] == sorted(r["order_key"] for r in found)
    wanted = Counter()
    for i, _, source, _ in rows:
        u = int(hashlib.md5(f"5:{i}".encode()).hexdigest()[:13], 16)
        term = total = math.exp(-of[source])
        n = 0
        while of[source] and math.floor(min(total, 1.0) * 2**52) <= u:
            n += 1
            term *= of[source] / n
            total += term
        wanted[i] += n
    assert Counter(r["doc_id"] for r in found) == +wanted
    assert all(1 <= r["copy"] <= r["n_copies"] and r["place"] == "k" for r in found)
    empty = docs.limit(0)
    assert mixing.mix(empty, mixing.source_rates(empty)).count() == 0


def test_sources_reach_their_share(spark):
    docs = spark.range(30000).select(
        F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("source")
    )
    weights = spark.createDataFrame([("hot", 1.0), ("rare", 1.0)], "source string, weight double")
    n = Counter(r["source"] for r in mixing.mix(docs, mixing.source_rates(docs, weights)).select("source").collect())
    assert abs(n["hot"] - 15000) < 700 and abs(n["rare"] - 15000) < 1500
