import random

import pytest
from pyspark.sql import functions as F

from causalog.operators import intents as W, list_edits as E, merge as M, resolve as R
from tests.helpers import N, as_dict
from tests.test_intents import intent, intents, list_present


class Plain:
    """A list edited one by one; elements are old indexes or (intent,)."""

    def __init__(self, size):
        self.now, self.gone = list(range(size)), {}

    def run(self, verb, index, seq):
        n = len(self.now)
        if verb == "list_clear":
            self.now = []
        elif verb in ("list_insert_at", "list_append", "list_prepend"):
            at = n if verb == "list_append" else 0 if verb == "list_prepend" else min(max(index, 0), n)
            self.now.insert(at, (seq,))
        else:
            at = {"list_pop_first": 0, "list_pop_last": n - 1}.get(verb, index)
            if 0 <= at < n:
                self.gone[seq] = self.now.pop(at)


VERBS = ["list_insert_at", "list_insert_at", "list_append", "list_prepend", "list_rmv", "list_rmv", "list_pop_first", "list_pop_last"]


def random_edits(rng, n, reach, clears=True):
    verbs = VERBS + ["list_clear"] * (clears and rng.random() < 0.3)
    return [(rng.choice(verbs), rng.randrange(-1, reach), seq) for seq in range(n)]


def test_block_and_length_steps_against_plain_lists():
    rng = random.Random(1)
    code = {"list_insert_at": E.INSERT, "list_append": E.INSERT, "list_prepend": E.INSERT, "list_rmv": E.REMOVE, "list_pop_first": E.REMOVE,
            "list_pop_last": E.POP_LAST, "list_clear": E.CLEAR}

    def place(verb, index):
        return {"list_insert_at": max(index, 0), "list_append": 1 << 62, "list_rmv": index}.get(verb, 0)

    for _ in range(300):
        edits = random_edits(rng, rng.randrange(1, 400 if rng.random() < 0.05 else 40), rng.choice([2, 6, 30]))
        codes, places, seqs = [code[v] for v, _, _ in edits], [place(v, i) for v, i, _ in edits], [s for _, _, s in edits]
        fixed, base, flats = E.length_steps(codes, places)
        for size in (0, 1, 3, 9, 40):
            plain = Plain(size)
            for e in edits:
                plain.run(*e)
            items = list(E.worked_out(size, seqs, codes, places))
            live = [x for seq, lo, w, on, _ in items if on for x in ([(seq,)] if seq is not None else range(lo, lo + w))]
            assert live == plain.now and len(live) == (base if fixed else size + base - sum(f < size for f in flats))
            assert {by: lo if seq is None else (seq,) for seq, lo, _, on, by in items if not on and by != E.CLEARED} == plain.gone
            assert [x for seq, lo, w, _, _ in items if seq is None for x in range(lo, lo + w)] == list(range(size))


def run(spark, values, edits, block):
    made = [intent(v, index=i, value=f"v{s}", seq=s) for v, i, s in edits]
    p = list_present(spark, values)
    got = W.run_intents(intents(spark, made), p, N, kinds=("l",), width=block)
    after = as_dict(R.list_tuple(M.merge_ops(p, got, N, "causal"))).get("x", [])
    popped = {r["intent_seq"]: r["data"] for r in W.list_popped(intents(spark, made), p, width=block).collect()}
    plain = Plain(len(values))
    for e in edits:
        plain.run(*e)
    name = lambda e: values[e] if isinstance(e, int) else f"v{e[0]}"
    assert after == [name(e) for e in plain.now]
    assert popped == {s: name(plain.gone[s]) if s in plain.gone else None for v, _, s in edits if "pop" in v}


@pytest.mark.parametrize("seed,n,block", [(1, 30, 8), (2, 40, 1000), (4, 5, 1)])
def test_batches_equal_lists_edited_one_by_one(spark, seed, n, block):
    rng = random.Random(seed)
    run(spark, list("abcdefgh")[:rng.randrange(9)], random_edits(rng, n, 9, clears=seed % 2 == 0), block)


def test_an_edit_sees_the_ones_before(spark):
    run(spark, ["old"], [("list_insert_at", 0, 0), ("list_rmv", 0, 1)], 1000)
    run(spark, ["old"], [("list_append", None, 0), ("list_append", None, 1), ("list_insert_at", 2, 2)], 1000)
    run(spark, [], [("list_pop_first", None, 0), ("list_append", None, 1), ("list_pop_last", None, 2), ("list_rmv", 0, 3), ("list_prepend", None, 4)], 2)


def test_composition_keeps_every_element(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for id in ("p", "q"):
        for site in (1, 2):
            n = rng.choice([3, 20, 47])
            plain = Plain(5)
            for v, i, s in random_edits(rng, n, 7):
                rows.append(intent(v, id=id, index=i, site=site, seq=s))
                plain.run(v, i, s)
            want[id, site] = plain
    sizes = spark.createDataFrame([(i, 5) for i in "pq"], "id string, __size long")
    got = E.list_items(intents(spark, rows), sizes, block=5).collect()
    for (id, site), plain in want.items():
        own = sorted((r for r in got if (r.id, r.site) == (id, site)), key=lambda r: r.ord)
        assert {r.by: r.lo if r.seq is None else (r.seq,) for r in own if not r.live and r.by != E.CLEARED} == plain.gone
        assert [(r.seq,) for r in own if r.live] == [e for e in plain.now if not isinstance(e, int)]
        before = 0
        for e in plain.now:
            if isinstance(e, int):
                before = e + 1
            else:
                assert next(r.old for r in own if r.seq == e[0]) >= before


def test_only_sequences_of_several_blocks_are_composed(spark, monkeypatch):
    rounds, composed = [], E.composed
    monkeypatch.setattr(E, "composed", lambda items: composed(rounds.append({r.id for r in items.select("id").distinct().collect()}) or items))
    made = [intent("list_append", id=id, seq=s) for id, n in (("short", 3), ("long", 10)) for s in range(n)]
    got = E.list_items(intents(spark, made), spark.createDataFrame([], "id string, __size long"), block=6).collect()
    assert rounds == [{"long"}]
    assert {(r.id, r.seq) for r in got} == {(i["id"], i["seq"]) for i in [{"id": m[0], "seq": s} for m, s in zip(made, [*range(3), *range(10)])]}
