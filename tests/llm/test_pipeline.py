import os

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from causalog.llm import registry
from causalog.llm.decontaminate import decontaminate
from causalog.llm.simhash import near_duplicates
from llm.docs import docs

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ids(df):
    return sorted(r.doc_id for r in df.collect())


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_and_run(spark):
    out = cp.run(spark, SF)
    assert [len(n) > 0 and callable(f) for n, f in cp.STAGES] == [True] * 5
    by = {}
    for r in out.collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert set(out.columns) >= set(COLUMNS) and len(by) == 8
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_quality_stage(spark, documents):
    left = set(ids(cp.quality_classifier(spark, documents, SF)))
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good, bad = [r.doc_id for r in labels if r.quality], [r.doc_id for r in labels if not r.quality]
    assert set(good) <= left and len(left & set(bad)) <= len(bad) / 2


def test_dedup_stage_keeps_one_of_each_group(spark, documents):
    left = cp.simhash_near_dedup(spark, documents, SF)
    assert left.columns == COLUMNS
    assert ids(left) == sorted({r.component_id for r in near_duplicates(documents).collect()})
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, "other words all along"), (None, "alone as an island is"), (4, None), (5, "")]
    got = cp.simhash_near_dedup(spark, docs(spark, rows), SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", "a b c d e"), ("3", "other words all along"), ("4", None), ("None", "alone as an island is")]


def test_decontamination_stage(spark, documents):
    found = decontaminate(documents, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(cp.benchmark_decontamination(spark, documents, SF)) == sorted(r.doc_id for r in found.where("n_hit = 0").collect())


def test_stages_decide_by_row_where_ids_are_null_or_shared(spark):
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").select("text").first()[0]
    rows = [(None, leak), (None, "clean words without an id"), (7, leak), (7, "clean words of a shared id"), (8, "clean words")]
    got = cp.benchmark_decontamination(spark, docs(spark, rows), SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("7", rows[3][1]), ("8", rows[4][1]), ("None", rows[1][1])]

    near, other, third = "a b c d e", "other words all along", "alone as an island is"
    rows = [(None, near), (None, near), (1, near), (2, other), (None, other), (1, third), (0, third), (None, "only without an id"), (None, "only without an id")]
    got = cp.simhash_near_dedup(spark, docs(spark, rows), SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("0", third), ("1", near), ("2", other), ("None", "only without an id")]


def test_mixing_stage_repeats_documents(spark, documents):
    got = cp.source_mixing(spark, documents, SF)
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    total = documents.agg(F.sum(words)).first()[0]
    assert got.columns == COLUMNS and abs(got.agg(F.sum(words)).first()[0] / total - 1.5) < 0.2
    assert max(r["count"] for r in got.groupBy("doc_id").count().collect()) == 2


def test_mixing_by_row_where_ids_are_null(spark):
    """Two sources whose rows share the null id keep their own targets."""
    rows = [(None, f"w{i} " * 20, "en", "a" if i % 4 else "b") for i in range(400)]
    got = cp.source_mixing(spark, docs(spark, rows), SF).groupBy("source").count().collect()
    # a weighs 3 and b 1, of 600 documents' words; b stops at twice its 100.
    assert {r.source: round(r["count"], -1) for r in got} == {"a": 450, "b": 150}


def test_stages_on_an_empty_table_and_clashing_columns(spark, documents):
    empty = docs(spark, [])
    odd = documents.limit(40).withColumns({c: F.lit(c) for c in ("_quality", "_doc", "_times", "_size", "shard", "id", "taken", "component_id")})
    for name, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        out = stage(spark, odd, SF)
        assert out.count() and set(out.columns) >= set(COLUMNS), name
        if name != "hilbert_sharding":
            assert out.columns == odd.columns


def test_registered_queries_have_their_numbers():
    names = [n for n in registry.SPARK if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.SQL) <= set(registry.SPARK)
    assert os.path.exists(cp.__file__)
