"""The pipeline and the registered queries on small tables."""

import os
import sys
from collections import Counter

import pytest

import corpus_pipeline
from ledgermill.llm import language, near_dups
from ledgermill.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        out.append(docs)
    return out


def test_stage_columns(stages):
    assert [len(corpus_pipeline.STAGES)] + [s.columns for s in stages[1:5]] == [5] + [stages[0].columns] * 4


def test_stages_equal_plain_versions(stages):
    from test_decontaminate import brute as hits
    from test_near_dups import brute as groups

    first, spoken, single, clean, mixed, shards = [s.collect() for s in stages]
    answered = language.identify(stages[0], language.fit(stages[0])).filter("not rejected").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in spoken) == sorted(r["doc_id"] for r in answered)
    assert len(spoken) >= 0.98 * len(first)
    rows = [(r["doc_id"], r["text"]) for r in spoken]
    assert sorted(r["doc_id"] for r in single) == sorted({c for _, _, c in groups(rows, near_dups.WIDTH)})
    bench = [(r["item_id"], r["text"]) for r in stages[0].sparkSession.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    found = {d: (n, h) for d, n, h, _ in hits([(r["doc_id"], r["text"]) for r in single], bench)}
    assert sorted(r["doc_id"] for r in clean) == sorted(d for d, (n, h) in found.items() if not h or h < n)
    texts = {r["doc_id"]: r["text"] for r in single}
    assert all((r["text"] == texts[r["doc_id"]]) == (found[r["doc_id"]][1] == 0) for r in clean)
    assert Counter(r["doc_id"] for r in mixed) == Counter(r["doc_id"] for r in shards)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean}
    assert {r["shard"] for r in shards} <= set(range(40))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_its_sql(spark, name):
    from checking import compare, duck

    n, verdict, _ = compare(spark, duck(SMALL), SMALL, name, QUERIES[name], ORACLES.get(name))
    assert n > 0 and verdict in ("ok", "rows only")


CLASHING = ("score", "copy", "rejected", "lang_pred", "n_copies", "order_key", "items", "spans", "n_words", "hit_words",
            "_place", "_mark", "_of", "mark", "row", "whole", "place", "sum", "id")


def test_stages_keep_clashing_columns_and_odd_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").drop("n_chars")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in CLASHING})
    odd = [(9001, None, "en", "web"), (9002, "", None, None), (None, "The and of it is.", "en", "web"), (9003, "x " * 200_000, "en", "web")]
    odd = spark.createDataFrame(odd * 2, "doc_id long, text string, lang string, source string")
    odd = odd.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING})
    docs = docs.unionByName(odd.select(docs.columns))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns
        assert found.dtypes == docs.dtypes
        found.write.parquet(f"{tmp_path}/{k}")
        found = spark.read.parquet(f"{tmp_path}/{k}")
        marks = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
        wrong = [F.col(c) != F.concat(F.lit(f"{c}:"), marks) for c in CLASHING]
        assert found.count() > 0 and all(found.filter(w).isEmpty() for w in wrong)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if k == 0:
            assert found.filter("text is null or text = ''").isEmpty()
            found = found.unionByName(odd.select(docs.columns))
        assert k in (0, 3) or not found.filter("text is null").isEmpty()
        docs = found


WITHOUT = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[-1] == {hidden!r} or name == {hidden!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
names = set(entry.queries())
assert not [n for n in names if n.startswith("op") and n[2].isdigit()] and "pipeline" not in names, names
assert len(names) >= 90 and set(entry.oracle_sql()) <= names
"""


@pytest.mark.parametrize("hidden", ["llm", "sentencepiece"])
def test_rest_works_without_this_package(hidden):
    import subprocess

    root = os.path.dirname(corpus_pipeline.__file__)
    done = subprocess.run([sys.executable, "-c", WITHOUT.format(hidden=hidden)], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
