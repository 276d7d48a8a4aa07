import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalog.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i is None, i or 0, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept)
    size = len(order[0][2]) // parts
    cut = [[tuple(v[p * size:(p + 1) * size]) for _, _, v, _ in kept] for p in range(parts)]
    books = [[tuple(v[p * size:(p + 1) * size]) for _, _, v, _ in order[:entries]] for p in range(parts)]

    def assign(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p])) for x in cut[p]]

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for x, (_, e) in zip(cut[p], assign(p)):
                got.setdefault(e, []).append(x)
            for e, xs in got.items():
                books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs))
    final = [assign(p) for p in range(parts)]
    out = [(null, i, label, [final[p][n][1] for p in range(parts)], [final[p][n][0] for p in range(parts)]) for n, (null, i, _, label) in enumerate(kept)]
    text = ",".join(str(x) for b in books for c in b for x in c)
    return sorted(out, key=repr), hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, **options):
    coded, books = V.compress(spark.createDataFrame(rows, SCHEMA), **options)
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.label, r.codes, r.errors) for r in coded.collect()), key=repr)
    want, text = brute(rows, **options)
    assert got == want and V.digest(books) == text


def sample(n, dims, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (12, dims))
    return [(int(i), (middle[i % 12] + rng.normal(0, spread, dims)).tolist(), int(i % 5)) for i in rng.permutation(n)]


def test_against_brute_force(spark):
    rows = sample(400, 16, 1)
    rows += [(7, rows[0][1], None), (7, rows[0][1], None), (None, rows[3][1], 2), (None, [0.0] * 16, None)]
    rows += [(900, None, 1), (901, [None] + [0.0] * 15, 1), (902, [math.nan] * 16, 1), (903, [0.0] * 15 + [-math.inf], 1)]
    check(spark, rows)
    check(spark, rows, entries=16, rounds=2, parts=2)


def test_one_vector_holds_most_rows(spark):
    rows = sample(150, 8, 2) + [(1000 + i, [0.125, -0.3] * 4, 9) for i in range(1500)]
    check(spark, rows, entries=32)


def test_ties_go_to_the_lower_entry_and_few_vectors_give_few_entries(spark):
    rows = [(i, [x / 1024] * 4, 0) for i, x in enumerate([0, 2, 4, 2, 1, 3, 3, 1, -1, -3])]
    check(spark, rows, entries=3)
    check(spark, rows[:2])
    check(spark, [(5, [0.5] * 4, 1)] * 3)


def test_large_components_stay_exact_and_too_large_are_refused(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-2**27, 2**27, 8) / 1024).tolist(), 0) for i in range(60)]
    check(spark, rows, entries=8)
    with pytest.raises(ValueError, match="64 bits"):
        V.compress(spark.createDataFrame([(1, [1e300] * 4, 0)], SCHEMA))
    for bad in ([(1, [0.0] * 4, 0), (2, [0.0] * 8, 0)], [(1, [0.0] * 6, 0)]):
        with pytest.raises(ValueError, match="one length"):
            V.compress(spark.createDataFrame(bad, SCHEMA))


def test_shortlist_keeps_every_nearest_entry():
    rng = np.random.default_rng(6)
    for _ in range(200):
        book, x = rng.integers(-9, 9, (20, 3)), rng.integers(-9, 9) + rng.integers(-2, 3, (15, 3))
        short = V.shortlist(x.min(0), x.max(0), book)
        far = ((x[:, None] - book[None]) ** 2).sum(2)
        entry, least = V.nearest(x, book, short)
        assert (entry == far.argmin(1)).all() and (least == far.min(1)).all()


def test_blocks_hold_every_row_once_and_boxes_narrow(spark):
    rows = spark.createDataFrame([(i, [int(c) for c in x]) for i, x in enumerate(np.random.default_rng(7).integers(0, 1000, (3000, 4)))], "key long, x array<long>")
    seeds = np.array([r.x for r in rows.limit(256).collect()]).reshape(-1, 2, 2).transpose(1, 0, 2)
    blocks = V.sorted_blocks(rows, seeds).collect()
    for part in (0, 1):
        own = [b for b in blocks if b.part == part]
        assert sorted(k for b in own for k in b["keys"]) == list(range(3000)) and all(b.n == len(b["keys"]) <= V.BLOCK for b in own)
        assert all(np.array_equal(np.array(b.x).reshape(-1, 2).sum(0), b.sums) for b in own)
        assert np.mean([np.prod(np.subtract(b.high, b.low) / 1000) for b in own if b.n == V.BLOCK]) < 0.35


def test_empty_tables_empty_vectors_and_clashing_columns(spark):
    coded, books = V.compress(spark.createDataFrame([], SCHEMA))
    assert coded.count() == 0 and books.shape == (4, 0, 0) and V.digest(books) == hashlib.sha256(b"").hexdigest()
    assert V.compress(spark.createDataFrame([(1, None, 1)], SCHEMA))[0].count() == 0
    coded, _ = V.compress(spark.createDataFrame([(1, [], 1), (None, [], None)], SCHEMA))
    assert [(r.codes, r.errors) for r in coded.collect()] == [([0] * 4, [0] * 4)] * 2
    extra = spark.createDataFrame(sample(20, 8, 8), SCHEMA).withColumns({c: F.lit(c) for c in ("x", "vec", "part", "curve", "codes", "errors", "n")})
    coded, _ = V.compress(extra.withColumnRenamed("vec_id", "key"), id_col="key")
    assert coded.columns == ["key", "label", "codes", "errors"] and coded.count() == 20


def test_label_error_puts_nulls_together(spark):
    df = spark.createDataFrame([(1, 5, 1), (2, 6, None), (3, 7, None), (4, 8, 1), (5, 9, 2)], "vec_id long, error long, label int")
    assert {r.vec_id: r.label_error for r in V.with_label_error(df).collect()} == {1: 13, 2: 13, 3: 13, 4: 13, 5: 9}
