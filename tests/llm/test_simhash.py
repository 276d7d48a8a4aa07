import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from causalog.llm.components import components
from causalog.llm.simhash import fingerprint, first_shared, links, near_duplicates, segments, variant_keys
from llm.docs import Union, docs


def naive(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashed = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÉé \t\n. ", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text.encode(), 4) % (1 << 64) == naive(text)


def test_segments_are_the_fewest():
    assert [w for _, w in segments(4)] == [21, 22, 21] and len(segments(2)) == 2 and sum(w for _, w in segments(6)) == 64


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_near_fingerprints_share_a_key(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(400):
        a, n = rng.getrandbits(64), rng.randrange(0, 9)
        pairs.append((signed(a), signed(a ^ sum(1 << b for b in rng.sample(range(64), n))), n))
    df = spark.createDataFrame(pairs, "a long, b long, n int").select(
        "n", F.array_intersect(variant_keys(F.col("a"), 4), variant_keys(F.col("b"), 4)).alias("common"), first_shared(F.col("a"), F.col("b"), 4).alias("bit"))
    for r in df.collect():
        assert (r.bit >= 0) == bool(r.common) and (r.n > 4 or r.common)
        assert not r.common or r.bit == min(k >> 32 for k in r.common)


def brute_classes(fps, distance):
    u = Union()
    for a in fps:
        u.find(a)
        for b in fps:
            if (a ^ b) % (1 << 64) and bin((a ^ b) % (1 << 64)).count("1") <= distance:
                u.join(a, b)
    return {a: u.find(a) for a in fps}


def test_links_give_the_classes_of_all_pairs(spark):
    rng = random.Random(9)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            values.add(signed(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6)))))
    want = brute_classes(values, 4)
    for bucket in (3, 256):  # with and without midpoints
        found = components(links(spark.createDataFrame([(v,) for v in values], "fp long"), 4, bucket))
        got = {r.node: r.root for r in found.collect()}
        assert {v: got.get(v, v) for v in values} == want


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(3)
    for n, m in ((30, 20), (60, 70)):
        edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))]
        edges += [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
        u = Union()
        for a, b in edges:
            u.join(a, b)
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: u.find(x) for e in edges if e[0] != e[1] for x in e}


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [
        (5, base), (3, base + " more"), (9, base.replace("w200 ", "other ")), (1, "quite another text of its own"),
        (2, None), (4, ""), (6, " \n"), (7, "Quite another TEXT of its own"), (7, "Quite another TEXT of its own"), (None, base), (8, "z " * 30_000),
    ]
    got = near_duplicates(docs(spark, rows)).collect()
    classes = brute_classes([naive(r[1]) for r in rows], 4)
    ids = {}
    for r in rows:
        if r[0] is not None:
            c = classes[naive(r[1])]
            ids[c] = min(ids.get(c, r[0]), r[0])
    want = sorted((str(r[0]), f"{naive(r[1]):016x}", ids[classes[naive(r[1])]]) for r in rows)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_empty_table_and_clashing_columns(spark):
    assert near_duplicates(docs(spark, [])).count() == 0
    extra = docs(spark, [(1, "a b"), (2, "A b")]).withColumns({c: F.lit(c) for c in ("id", "fp", "key", "node", "component_id")})
    assert {r.component_id for r in near_duplicates(extra).collect()} == {1}
