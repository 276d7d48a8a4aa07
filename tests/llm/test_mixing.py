import hashlib
import heapq

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from causalog.llm.mixing import mix, sainte_lague
from llm.docs import docs


def quotients(votes, seats, most):
    """Sainte-Lague one seat at a time."""
    won = dict.fromkeys(votes, 0)
    heap = [(-v, k) for k, v in votes.items() if v > 0 and most[k] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, k = heapq.heappop(heap)
        won[k] += 1
        if won[k] < most[k]:
            heapq.heappush(heap, (-votes[k] / (2 * won[k] + 1), k))
    return {k: n for k, n in won.items() if votes[k] > 0}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=9), st.integers(1, 120))
def test_seats_by_highest_quotients(spark, votes, seats):
    votes = dict(enumerate(votes))
    parties = spark.createDataFrame([(0, k, float(v)) for k, v in votes.items()], "g int, k int, v double")
    got = {r.k: r.quota for r in sainte_lague(parties, ["g"], "k", "v", F.lit(seats), F.lit(10_000)).collect()}
    assert got == quotients(votes, seats, dict.fromkeys(votes, 10_000))


def test_many_seats_and_equal_votes(spark):
    votes = {k: float(v) for k, v in enumerate([10, 10, 10, 3, 1])}
    parties = spark.createDataFrame([(0, k, v) for k, v in votes.items()], "g int, k int, v double")
    for seats in (1, 2, 7, 1000):
        got = {r.k: r.quota for r in sainte_lague(parties, ["g"], "k", "v", F.lit(seats), F.lit(10**6)).collect()}
        assert got == quotients(votes, seats, dict.fromkeys(votes, 10**6))


def targets(sizes, weights, share, times):
    """Fill up by weight; what is above a cap is dealt again until none is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        level = rest / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level > times * sizes[s]]
        if not over:
            return {**fixed, **{s: w[s] * level for s in free}}
        fixed |= {s: times * sizes[s] for s in over}


ROWS = (
    [(i, "w " * (1 + i * 37 % 200), "en", f"s{i % 4}") for i in range(300)]
    + [(1000 + i, "z " * 30, "en", None) for i in range(5)]
    + [(2000, None, "en", "s1"), (2001, "", "en", "s2"), (2002, "big " * 20_000, "en", "s0"), (None, "a b c", "en", "s3"), (5, "w " * 40, "en", "s1")]
)


def test_targets_and_takings(spark):
    got = mix(docs(spark, ROWS), shard_rows=16).collect()
    assert len(got) == len(ROWS)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = targets(sizes, [3, 1, 2], 1.5, 2)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 16 * 4, s
    assert max(r.shard for r in got) > 0


def test_every_shard_takes_one_run_of_its_ring(spark):
    got = mix(docs(spark, ROWS), shard_rows=16, block=4)
    rings = {}
    for r in got.collect():
        tag = hashlib.md5(f"7:{'' if r.doc_id is None else r.doc_id}:{r.size}".encode()).hexdigest()
        rings.setdefault((r.source, r.shard), []).append((tag, r.size, r.taken))
    for members in rings.values():
        # A run covers whole documents but for its two ends.
        members = [m for m in sorted(members) if m[1]]
        total, most = sum(m[2] for m in members), sum(m[1] for m in members)
        low = total // most if most else 0
        cut = [m for m in members if m[2] not in (low * m[1], (low + 1) * m[1])]
        assert len(cut) <= 2


def test_reruns_agree_and_rows_may_come_in_any_order(spark):
    a = sorted(map(repr, mix(docs(spark, ROWS)).collect()))
    b = sorted(map(repr, mix(docs(spark, ROWS[::-1]).repartition(7)).collect()))
    assert a == b


def test_empty_and_wordless_tables_and_clashing_columns(spark):
    assert mix(docs(spark, [])).count() == 0
    assert [(r.target, r.taken) for r in mix(docs(spark, [(1, ""), (2, None)])).collect()] == [(0.0, 0), (0.0, 0)]
    extra = docs(spark, ROWS[:20]).withColumns({c: F.lit(c) for c in ("id", "idx", "size", "tag", "shard", "target", "rows", "x", "quota")})
    assert mix(extra).count() == 20
