import random

import pytest

from causalog.functions.positions import bulk_positions, position_at, with_gap
from causalog.operators import intents as W, lookup as L, merge as M, resolve as R
from causalog.operators.present import causal_present
from tests.helpers import N, as_dict, op, ops, present, rows

SCHEMA = (
    "id string, verb string, key string, value string, delta bigint, index bigint, site int, wall_ms bigint, intent_seq bigint"
)


def intents(spark, made):
    return spark.createDataFrame(made, SCHEMA)


def intent(verb, id="x", key=None, value=None, delta=None, index=None, site=1, wall=0, seq=0):
    return (id, verb, key, value, delta, index, site, wall, seq)


class Site:
    """One writer run intent by intent: what the batch must equal."""

    def __init__(self, site, start, clock):
        self.site, self.rows, self.clock = site, list(start), clock

    def visible(self, id, type):
        top = [r for r in self.rows if r[0] == id and r[2] == type]
        own = [r for r in top if not any(r[1] == o[1] and r[5] != o[5] and all(a <= b for a, b in zip(r[5], o[5])) for o in top)]
        return sorted({r[1] for r in own if r[7] == "a"})

    def write(self, id, type, cells, wall, seq, kind):
        """cells: (key, data) pairs sharing one timestamp."""
        if not cells:
            return []
        lts = [max([r[5][j] for r in self.rows if r[0] == id], default=0) for j in range(N)]
        lts[self.site - 1] += 1
        physical, logical = self.clock
        self.clock = (wall, 1) if wall > physical else (physical, logical + 1)
        new = [(id, key, type, data, self.site, lts, self.clock, kind, seq) for key, data in cells]
        self.rows += new
        return new

    def run(self, it):
        id, verb, key, value, delta, _, _, wall, seq = it
        if verb.endswith("clear"):
            type = verb[0]
            return self.write(id, type, [(k, None) for k in self.visible(id, type)], wall, seq, "r")
        if verb == "register_set":
            return self.write(id, "r", [("", value)], wall, seq, "a")
        if verb.startswith("counter"):
            mine = [r for r in self.rows if r[0] == id and r[1] == str(self.site)]
            base = int(max(mine, key=lambda r: r[5][self.site - 1])[3]) if mine else 0
            total = base + (delta if verb == "counter_inc" else -delta)
            return self.write(id, "c", [(str(self.site), str(total))], wall, seq, "a")
        type, kind = verb[0], "a" if verb.endswith("add") else "r"
        data = value if verb == "map_add" else None
        return self.write(id, type, [(key, data)], wall, seq, kind)


@pytest.mark.parametrize("seed,width", [(1, 3), (2, 7), (3, 1 << 20)])
def test_batch_equals_running_one_by_one(spark, seed, width):
    """Small widths cut every running total into many buckets."""
    rng = random.Random(seed)
    start = []
    for type, sid in (("s", "s0"), ("m", "m0"), ("c", "c0"), ("r", "r0")):
        for s in (1, 2, 3):
            lts = [0] * N
            lts[s - 1] = 1
            key = {"c": str(s), "r": ""}.get(type, rng.choice("abc"))
            start.append(op(id=sid, key=key, type=type, data="5", site=s, lts=lts, pts=(50, 1), op="a" if type in "cr" else rng.choice("ar")))
    verbs = [("register_set", "r"), ("set_add", "s"), ("set_rmv", "s"), ("set_clear", "s"), ("map_add", "m"),
             ("map_rmv", "m"), ("map_clear", "m"), ("counter_inc", "c"), ("counter_dec", "c")]
    made = []
    for seq in range(90):
        verb, t = rng.choice(verbs)
        made.append(intent(verb, f"{t}{rng.randrange(2)}", rng.choice("abcd"), str(seq), rng.randrange(9), None,
                           rng.randrange(1, 4), rng.randrange(120), seq))
    sites = {s: Site(s, [r[:9] for r in start], (50, 3)) for s in (1, 2, 3)}
    want = sorted([r for it in made for r in sites[it[6]].run(it)], key=repr)
    seeds = spark.createDataFrame([(s, 50, 3) for s in (1, 2, 3)], "site int, physical_time bigint, logical_time int")
    got = W.run_intents(intents(spark, made), present(spark, start), N, seeds, kinds=("r", "s", "m", "c"), width=width)
    have = sorted([(*r[:5], list(r["lts"]), tuple(r["pts"]), r["op"], r["seq"]) for r in got.collect()], key=repr)
    assert have == want


def list_present(spark, values):
    return present(spark, [op(type="l", key=f"{chr(66 + i)}1", data=v, lts=(i + 1, 0, 0)) for i, v in enumerate(values)])


def after(spark, p, made, mode="regular", width=20):
    got = W.run_intents(intents(spark, made), p, N, kinds=("l",), mode=mode, width=width)
    return as_dict(R.list_tuple(M.merge_ops(p, got, N, "causal"))).get("x", [])


@pytest.mark.parametrize("mode", ["regular", "appends", "prepends"])
def test_appends_and_prepends_keep_sequential_order(spark, mode):
    made, want = [], ["p", "q"]
    for seq in range(40):
        if seq % 3 == 0:
            made.append(intent("list_prepend", value=str(seq), seq=seq))
            want.insert(0, str(seq))
        else:
            made.append(intent("list_append", value=str(seq), seq=seq))
            want.append(str(seq))
    assert after(spark, list_present(spark, ["p", "q"]), made, mode) == want
    assert after(spark, list_present(spark, []), made, mode) == [x for x in want if x not in "pq"]


def test_inserts_in_one_gap_and_past_the_end(spark):
    p = list_present(spark, ["p", "q"])
    made = [intent("list_insert_at", value=v, index=i, seq=s) for s, (v, i) in enumerate([("a", 1), ("b", 1), ("z", 99), ("c", 0), ("y", 99)])]
    assert after(spark, p, made) == ["c", "p", "b", "a", "q", "z", "y"]


def test_pops_remove_and_clear(spark):
    p = list_present(spark, list("abcde"))
    made = [intent("list_pop_first", seq=0), intent("list_pop_last", seq=1), intent("list_pop_first", seq=2), intent("list_rmv", index=2, seq=3)]
    assert after(spark, p, made) == ["c", "d"]  # index 2 is past the end of what the pops left
    popped = W.list_popped(intents(spark, made), p, width=2)
    assert [r["data"] for r in popped.orderBy("intent_seq").collect()] == ["a", "e", "b"]
    many = [intent("list_pop_last", seq=i) for i in range(7)]
    assert [r["data"] for r in W.list_popped(intents(spark, many), p).orderBy("intent_seq").collect()] == ["e", "d", "c", "b", "a", None, None]
    assert after(spark, p, many) == []
    mixed = [intent("list_append", value="f", seq=0), intent("list_clear", seq=1), intent("list_append", value="g", seq=2)]
    assert after(spark, p, mixed) == ["g"]
    assert after(spark, p, [intent("list_rmv", index=9, seq=0)]) == list("abcde")


def test_concurrent_inserts_at_one_place_converge(spark):
    p = list_present(spark, ["p", "q"])
    a = W.run_intents(intents(spark, [intent("list_insert_at", value="a", index=1, site=1)]), p, N, kinds=("l",))
    b = W.run_intents(intents(spark, [intent("list_insert_at", value="b", index=1, site=2)]), p, N, kinds=("l",))
    rm = W.run_intents(intents(spark, [intent("list_rmv", index=1, site=3)]), p, N, kinds=("l",))
    merged = M.merge_ops(M.merge_ops(p, b, N), a.unionByName(rm), N)
    assert as_dict(R.list_tuple(merged)) == {"x": ["p", "a", "b"]}


def between(spark, lo, hi, n=1, mode="regular"):
    df = spark.createDataFrame([(lo, hi, n, r, "") for r in range(1, n + 1)], "lo string, hi string, n bigint, r bigint, s string")
    df = with_gap(df, "lo", "hi", "n", "s", site_digits=0).withColumn("pos", position_at("n", "r", mode))
    return [r["pos"] for r in df.orderBy("r").collect()]


def test_single_positions(spark):
    assert between(spark, "", "") == ["P"]
    assert between(spark, None, None) == ["P"]
    assert between(spark, "a", "c") == ["b"]
    assert between(spark, "a", "b") == ["aP"]
    assert between(spark, "aZ", "bA") == ["aZP"]
    assert between(spark, "a", "f", mode="appends") == ["b"]
    assert between(spark, "a", "f", mode="prepends") == ["e"]
    with pytest.raises(ValueError):
        position_at("n", "r", "sideways")


@pytest.mark.parametrize("mode", ["regular", "appends", "prepends"])
def test_bulk_positions_are_ordered_and_short(spark, mode, monkeypatch):
    monkeypatch.setattr("causalog.sources.ops.ENTRIES_PER_TASK", 1000)
    bounds = [("a", "", "", 20000, 1), ("b", "P1", "P2", 500, 2), ("c", "~~1", "", 94, 3), ("d", "", "!1", 3, 1), ("e", "k", "l", 0, 1)]
    df = spark.createDataFrame(bounds, "id string, lo string, hi string, n bigint, site int")
    got = {}
    for r in bulk_positions(df, mode).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["pos"])
    assert {k: len(v) for k, v in got.items()} == {b[0]: b[3] for b in bounds if b[3]}
    for id, lo, hi, n, site in bounds:
        made = got.get(id, [])
        assert made == sorted(set(made))
        assert all(lo < p and (not hi or p < hi) for p in made)
    assert max(map(len, got["a"])) <= 5


def test_positions_of_many_sites_are_distinct(spark):
    df = spark.createDataFrame([(f"x{s}", None, None, n, s) for s, n in ((1, 2000), (11, 60), (2, 300))], "id string, lo string, hi string, n long, site int")
    made = [r.pos for r in bulk_positions(df, site_digits=2).collect()]
    assert len(set(made)) == 2360
    with pytest.raises(Exception, match="more than 1 digits"):
        bulk_positions(df).collect()


def test_link_integrity_chains_and_rejects_cycles(spark):
    schema = "outer_id string, outer_key string, inner_id string, add_verb string"
    links = spark.createDataFrame([("m", "k", "s", "map_add"), ("top", None, "m", "set_add"), ("l", "2", "other", "list_insert_at")], schema)
    log = ops(spark, [op(id="s", type="s", pts=(9, 1), seq=4, site=2), op(id="free", seq=5)])
    got = W.link_integrity(log, links)
    assert rows(got.select("id", "verb", "key", "value", "site", "wall_ms", "intent_seq")) == [
        ("m", "map_add", "k", "s", 2, 9, 4), ("top", "set_add", "m", None, 2, 9, 4)]
    assert W.link_integrity(log, links.limit(0)).count() == 0
    long = spark.createDataFrame([(f"n{i + 1}", "k", f"n{i}", "map_add") for i in range(5000)], schema)
    got = W.link_integrity(ops(spark, [op(id="n0", seq=1), op(id="n4990", seq=2)]), long)
    assert got.groupBy("intent_seq").count().orderBy("intent_seq").collect() == [(1, 5000), (2, 10)]
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    # Two ways up give the entries above twice.
    ways = spark.createDataFrame([("a", None, "x", "set_add"), ("b", None, "x", "set_add"), ("t", "1", "a", "map_add"), ("t", "2", "b", "map_add"), ("u", None, "t", "set_add")], schema)
    assert sorted(r["id"] for r in W.link_integrity(ops(spark, [op(id="x", seq=1)]), ways).collect()) == ["a", "b", "t", "t", "u", "u"]
    loop = spark.createDataFrame([("a", None, "b", "set_add"), ("b", None, "a", "set_add")], schema)
    with pytest.raises(ValueError):
        W.link_integrity(log, loop)


def test_outer_entry_survives_concurrent_remove(spark):
    outer = present(spark, [op(id="m", key="k", data="s", lts=(1, 0, 0)), op(id="s", type="s", key="e", lts=(1, 0, 0))])
    links = spark.createDataFrame([("m", "k", "s", "map_add")], "outer_id string, outer_key string, inner_id string, add_verb string")
    add = W.run_intents(intents(spark, [intent("set_add", "s", "f", site=2, wall=5)]), outer, N, kinds=("s",))
    keep = W.run_intents(W.link_integrity(add, links), outer, N, kinds=("m",))
    gone = W.run_intents(intents(spark, [intent("map_rmv", "m", "k", site=3, wall=6)]), outer, N, kinds=("m",))
    merged = causal_present(outer.unionByName(M.as_merged(add)).unionByName(M.as_merged(keep)).unionByName(M.as_merged(gone)), N)
    ids = spark.createDataFrame([("m",)], "id string")
    assert L.map_get(ids, merged, "aw_lww").collect()[0]["data"][0]["value"] == "s"
