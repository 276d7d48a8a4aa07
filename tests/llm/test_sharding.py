import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalog.llm.sharding import hilbert_index, hilbert_shards, matching_shards, shard_bounds, write_shards
from llm.docs import docs


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    at = hilbert_index(cells, bits)
    assert sorted(at) == list(range(len(cells)))
    path = cells[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def shards(spark, rows, n=8, **options):
    d = docs(spark, rows).withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))))
    return hilbert_shards(d, ["size", "lang", "source"], n, ties=[F.col("doc_id")], **options)


ROWS = [(i, "x" * (i * 7 % 90), "ab"[i % 2], f"s{i % 5}") for i in range(101)] + [
    (None, None, None, None), (200, "", None, "s1"), (201, "y" * 40_000, "a", "s1"), (7, "x" * 49, "b", "s2"), (7, "x" * 49, "b", "s2")]


def test_shards_differ_by_one_row_and_slots_have_no_gap(spark):
    got = shards(spark, ROWS).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((r[0] or -1, r[1] or "") for r in ROWS)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    in_order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert in_order == sorted(in_order)


def test_one_cell_with_most_rows_is_cut(spark):
    got = shards(spark, [(i, "same", "a", "s") for i in range(80)]).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [10] * 8


def test_few_rows_empty_table_and_clashing_columns(spark):
    assert shards(spark, []).count() == 0
    assert sorted((r.shard, r.slot) for r in shards(spark, ROWS[:3]).collect()) == [(0, 0), (2, 0), (5, 0)]
    d = docs(spark, ROWS[:9]).withColumns({c: F.lit(1) for c in ("shard", "slot", "curve", "d0", "p0", "t0", "at", "rank", "part", "offset", "n")})
    out = hilbert_shards(d, ["n_chars", "lang"], 3, ties=[F.col("doc_id")])
    assert len(set(out.columns)) == len(out.columns) and out.count() == 9


def test_written_shards_prune_by_bounds(spark, tmp_path):
    d = spark.range(4096).select(F.col("id").alias("doc_id"), (F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"))
    out = hilbert_shards(d, ["x", "y"], 16, bits=6, ties=[F.col("doc_id")])
    write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    bounds = shard_bounds(back, ["x", "y"])
    box = {"x": (0, 10), "y": (20, 30)}
    hit = {r.shard for r in matching_shards(bounds, box).collect()}
    true = {r.shard for r in back.where("x <= 10 and y between 20 and 30").select("shard").distinct().collect()}
    assert true <= hit and len(hit) <= 4


def test_long_common_beginnings_are_told_apart(spark):
    urls = [(i, "x", "a", f"https://www.example.com/a/very/long/beginning/{i:04d}") for i in range(1000)]
    d = docs(spark, urls)
    one = hilbert_shards(d, ["source"], 8, payload=["source"])
    assert one.select("curve").distinct().count() == 32
    ranks = {r.source: r.curve for r in one.collect()}
    assert [ranks[u[3]] for u in urls] == sorted(ranks.values()) and max(list(ranks.values()).count(c) for c in set(ranks.values())) <= 33


def test_query_against_brute_force(spark, tmp_path):
    import zlib

    from causalog.llm.registry import op6_sharding
    docs(spark, ROWS).write.parquet(str(tmp_path / "documents.parquet"))
    got = op6_sharding(spark, str(tmp_path)).collect()
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want
    slots = sorted((r.shard, r.slot) for r in got)
    sizes = [sum(s == k for s, _ in slots) for k in range(8)]
    assert slots == [(k, i) for k in range(8) for i in range(sizes[k])] and max(sizes) - min(sizes) <= 1
    assert all(r.law == "rows" and r.grown_shard is None for r in got)
