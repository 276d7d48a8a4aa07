import hashlib
import re

import pandas as pd
from pyspark.sql import functions as F

from causalog.llm.exact_dedup import exact_dedup, heavy_digests, misra_gries
from llm.docs import docs


def brute(rows):
    groups = {}
    for i, r in enumerate(rows):
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0d]", "", r[1] or "").encode()).hexdigest()
        groups.setdefault(digest, []).append((-len(r[1] or ""), r[0] is None, r[0] or 0, i))
    out = []
    for digest, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), digest))
    return sorted(out, key=repr), len(groups)


ROWS = [
    (3, "a b"), (1, "ab"), (2, "a\tb\n"), (4, "A b"), (5, None), (6, ""), (7, " \x0b"), (None, "ab"), (None, None),
    (8, "é è"), (9, "éè"), (10, "x" * 50_000), (10, "x" * 50_000), (11, "a b"), (12, "a b"),
]


def check(spark, rows, **options):
    got = exact_dedup(docs(spark, rows), **options).collect()
    want, groups = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_against_brute_force(spark):
    check(spark, ROWS)


def test_heavy_and_light_digests_agree(spark):
    rows = [(i, f"text {i % 7 if i % 3 else 0}") for i in range(300)]
    for counters in (1, 2, 4, 1000):
        check(spark, rows, counters=counters)


def test_empty_table_and_clashing_columns(spark):
    assert exact_dedup(docs(spark, [])).count() == 0
    extra = docs(spark, ROWS).withColumns({c: F.lit(c) for c in ("id", "digest", "row", "kept", "best", "group_size")})
    assert exact_dedup(extra).count() == len(ROWS)


def test_summary_keeps_every_frequent_value():
    values = [i % 10 if i % 2 else 99 for i in range(5000)]
    batches = [pd.DataFrame({"digest": values[i:i + 500]}) for i in range(0, 5000, 500)]
    held = pd.concat(misra_gries(3)(iter(batches))).set_index("digest")["at_least"]
    assert len(held) <= 3 and 2500 - 5000 // 4 <= held[99] <= 2500


def test_heavy_digests_are_bounded(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).cast("string").cast("binary").alias("digest"))
    heavy = heavy_digests(rows, 8).collect()
    assert len(heavy) <= 8 and bytearray(b"0") in [r.digest for r in heavy]
