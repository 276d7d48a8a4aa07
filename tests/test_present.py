import random

import pytest
from pyspark.sql import functions as F

from causalog.operators import audit as A, merge as M, present as P
from causalog.schema import split_rejects
from tests.helpers import N, frontier, op, ops, present, rows


def versions(df):
    return sorted((r["key"], tuple(r["lts"]), r["site"]) for r in df.collect())


def test_incomparable_clocks_survive_but_prefilter_drops_the_middle(spark):
    log = ops(spark, [op(lts=(3, 0), site=1), op(lts=(0, 3), site=2), op(lts=(2, 2), site=1, seq=2)])
    assert len(P.causal_present(log, 2).collect()) == 3
    kept = P.causal_present(log, 2, prefilter=True)
    assert versions(kept) == [("k", (0, 3), 2), ("k", (3, 0), 1)]


def test_copies_collapse_and_merged_copy_stays(spark):
    row = op(lts=(1, 0, 0))
    both = P.local_and_shared(present(spark, [row]), ops(spark, [row, row]))
    for mode in ("exact", "causal"):
        got = P.causal_present(both, N, mode=mode).collect()
        assert len(got) == 1 and got[0]["merged_at"] == 0


def test_equal_clocks_of_different_sites_survive(spark):
    log = ops(spark, [op(site=1, lts=(1, 1, 0)), op(site=2, lts=(1, 1, 0))])
    assert len(P.causal_present(log, N).collect()) == 2
    assert len(P.causal_present(log, N, mode="causal").collect()) == 2


def test_exact_frontier_on_random_clocks(spark, monkeypatch):
    """Large antichains in one element, cut into many small blocks."""
    monkeypatch.setattr(P, "BLOCK_ROWS", 8)
    monkeypatch.setattr(P, "NEAR_ROWS", 8)
    rng = random.Random(3)
    made = {(rng.choice("pq"), (rng.randrange(40), rng.randrange(40), rng.randrange(40)), rng.randrange(1, 4)) for _ in range(900)}
    log = ops(spark, [op(key=k, lts=c, site=s, seq=i) for i, (k, c, s) in enumerate(sorted(made))])
    assert versions(P.causal_present(log, N)) == frontier(made)


@pytest.mark.parametrize("sites", [3, 6])
def test_frontier_of_mutually_concurrent_clocks_compares_near_ones_only(spark, sites):
    """Clocks on a curved surface: hardly any dominates another, and coordinate sums differ."""
    rng = random.Random(sites)
    made = set()
    while len(made) < 4000:
        x = [rng.random() + 0.01 for _ in range(sites)]
        length = sum(v * v for v in x) ** 0.5
        made.add(("k", tuple(int(100_000 * v / length) for v in x)))
    clocks = spark.createDataFrame(sorted(made), "key string, lts array<bigint>")
    blocked = P._near_blocks(clocks, sites, ["key"], "lts")
    assert blocked.count() == len(made) and blocked.groupBy("key", "__block").count().agg({"count": "max"}).first()[0] <= 64
    got = P._dominated_clocks(clocks, sites, ["key"], "lts")
    below = {a for _, a in made for _, b in made if a != b and all(i <= j for i, j in zip(a, b))}
    assert {tuple(r["lts"]) for r in got.collect()} == below
    if sites == 3:  # of 63 blocks
        assert P._probes(blocked, sites, ["key"], "lts").count() < 8 * len(made)


def test_clocks_of_equal_sums_are_not_compared(spark):
    clocks = spark.range(20_000).select(F.lit(None).cast("string").alias("key"), F.array("id", 20_000 - F.col("id"), F.lit(2**62)).alias("lts"))
    blocked = P._near_blocks(clocks, 3, ["key"], "lts")
    assert P._probes(blocked, 3, ["key"], "lts").count() == 0
    assert P._clock_frontier(clocks, 3, ["key"], "lts").count() == 20_000


def test_frontier_is_idempotent(spark):
    rng = random.Random(5)
    log = ops(spark, [op(key=str(rng.randrange(5)), lts=[rng.randrange(9) for _ in range(3)], seq=i) for i in range(200)])
    once = P.causal_present(log, N)
    assert versions(P.causal_present(once, N)) == versions(once)


def causal_log(seed, n=300, sites=N):
    """Sites write to few structures and sometimes pull everything another site knows."""
    rng = random.Random(seed)
    known = {s: [] for s in range(1, sites + 1)}
    out = []
    for i in range(n):
        s = rng.randrange(1, sites + 1)
        if rng.random() < 0.15:
            known[s] = list({id(o): o for o in known[s] + known[rng.randrange(1, sites + 1)]}.values())
        sid = f"x{rng.randrange(3)}"
        clock = [max([o[5][j] for o in known[s] if o[0] == sid], default=0) for j in range(sites)]
        clock[s - 1] += 1
        row = op(id=sid, key=f"k{rng.randrange(4)}", data=str(i), site=s, lts=clock, pts=(i, 1),
                 op=rng.choice("aar"), seq=i, arrival=i)
        known[s].append(row)
        out.append(row)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_modes_agree_on_causal_logs(spark, seed):
    log = ops(spark, causal_log(seed))
    assert A.check_causal(log, N).count() == 0
    exact = rows(P.causal_present(log, N))
    assert exact == rows(P.causal_present(log, N, mode="causal"))
    assert exact == rows(P.causal_present(log, N, prefilter=True))


@pytest.mark.parametrize("batches", [1, 3, 17])
def test_merge_ignores_order_replay_and_batch_cuts(spark, batches):
    log = causal_log(11, 150)
    want = rows(M.merge_ops(present(spark, []), ops(spark, log), N))
    shuffled = random.Random(batches).sample(log, len(log)) + log[:40]
    cut = (len(shuffled) + batches - 1) // batches
    from causalog.session import stable
    state = present(spark, [])
    for i in range(0, len(shuffled), cut):
        state = stable(M.merge_ops(state, ops(spark, shuffled[i:i + cut]), N, "causal"))
    assert rows(state) == want


def test_read_modes(spark):
    local = present(spark, [op(lts=(1, 0, 0), data="old")])
    shared = ops(spark, [op(lts=(2, 0, 0), data="new")])
    assert [r["data"] for r in P.present(local, shared, N, "local").collect()] == ["old"]
    assert [r["data"] for r in P.present(local, shared, N, "all").collect()] == ["new"]
    assert P.all_rows(local, shared, "all").count() == 2
    with pytest.raises(ValueError):
        P.present(local, shared, N, "both")


def test_rejects_complete_the_input(spark):
    bad = [op(type="z"), op(op="x"), op(site=9), op(lts=(1, 1, 1, 1)), op(id=None), op(op=None)]
    good, rejects = split_rejects(ops(spark, [op(), *bad]), N)
    assert good.count() == 1 and rejects.count() == len(bad)


def test_dedup_keeps_one_of_each_identity(spark):
    log = ops(spark, [op(hops=2, seq=9), op(hops=0, seq=9), op(site=2, lts=(0, 1, 0))])
    got = P.dedup_ops(log).collect()
    assert len(got) == 2 and {r["hops"] for r in got} == {0}


def test_merge_helpers(spark):
    here = present(spark, [op(lts=(2, 0, 0)), op(key="z", lts=(0, 1, 0), site=2)])
    batch = ops(spark, [
        op(lts=(1, 0, 0)), op(lts=(2, 0, 0)), op(lts=(2, 1, 0), site=2), op(key="new", lts=(0, 0, 1), site=3, hops=1),
    ])
    fresh = M.drop_obsolete(batch, here, N)
    assert versions(fresh) == [("k", (2, 1, 0), 2), ("new", (0, 0, 1), 3)]
    assert versions(M.superseded(here, batch, N)) == [("k", (2, 0, 0), 1)]
    log = ops(spark, [op(key="new", lts=(0, 0, 1), site=3)])
    got = M.receive_ops(batch.unionByName(batch), 2, here, log, 77, N).collect()
    assert [(r["key"], r["hops"], r["arrival_time"]) for r in got] == [("k", 0, 77)]
    assert M.receive_ops(batch, 1, here, log.limit(0), 5, N).agg({"hops": "sum"}).collect()[0][0] == 3
    assert {r["site"]: r["unmerged"] for r in M.backlog(batch, here, N).collect()} == {2: 1, 3: 1}
    assert not M.fully_merged(batch, here, N).collect()[0][0]
    assert M.fully_merged(batch.limit(0), here, N).collect()[0][0]
    hops = ops(spark, [op(hops=h, site=1 + h % 3) for h in range(5)])
    assert M.forwardable(hops).count() == 3
    assert M.forwardable(hops, next_site=1).count() == 3


def test_audit(spark):
    a, b = op(lts=(1, 0, 0)), op(id="y", site=2, lts=(0, 1, 0))
    same = present(spark, [a, b])
    replicas = same.withColumn("replica", F.lit(1)).unionByName(same.where("id = 'x'").withColumn("replica", F.lit(2)))
    got = {r["id"]: r["converged"] for r in A.converged(replicas, 2).collect()}
    assert got == {"x": True, "y": False}
    assert A.missing_ops(same, same.where("id = 'x'")).count() == 1
    broken = ops(spark, [op(lts=(1, 5, 0)), op(lts=(2, 4, 0)), op(lts=(4, 5, 0)), op(id="d"), op(id="d", key="j")])
    assert {(r["id"], r["own"], r["reason"]) for r in A.check_causal(broken, N).collect()} == {
        ("x", 2, "regress"), ("x", 4, "gap"), ("d", 1, "repeat")}
    cleared = ops(spark, [op(key="i", op="r"), op(key="j", op="r")])
    assert A.check_causal(cleared, N).count() == 0
    kinds = ops(spark, [op(), op(site=2, op="r"), op(key="j"), op(key="j", site=2), op(key="i")])
    assert {(r["key"], r["kind"]) for r in A.conflicts(kinds).collect()} == {("k", "add/remove"), ("j", "add/add")}


@pytest.mark.parametrize("mode", ["causal", "exact"])
def test_null_keys_stay_and_unknown_sites_fail(spark, mode):
    log = ops(spark, [op(key=None, data="a"), op(key=None, data="b", site=2, lts=(0, 1, 0)), op(key=None, data="old", site=2, lts=(0, 0, 0)), op(key="k")])
    assert sorted(r["data"] or "" for r in P.causal_present(log, N, mode=mode).collect()) == ["", "a", "b"]
    with pytest.raises(Exception, match="does not fit 2 sites"):
        P.causal_present(ops(spark, [op(site=3, lts=(0, 0, 1)), op()]), 2, mode=mode).collect()
