import random

import pytest

from causalog.operators import merge as M, resolve as R
from causalog.operators.compaction import compact, droppable, stable_clocks
from causalog.operators.present import causal_present
from tests.helpers import N, op, ops, present, rows
from tests.test_present import causal_log

VIEWS = (R.set_aw, R.set_rw, R.set_lww)


def test_a_remove_goes_once_every_site_has_seen_it(spark):
    gone = op(type="s", key="a", op="r", lts=(1, 0, 0))
    later = [op(type="s", key="b", site=s, lts=lts) for s, lts in ((1, (2, 0, 0)), (2, (1, 1, 0)), (3, (1, 1, 1)))]
    both = op(type="s", key="c", op="r", site=1, lts=(2, 0, 0)), op(type="s", key="c", site=2, lts=(1, 2, 0))
    for known, want in ((later, [("a", "r", True)]), (later[:2], [("a", "r", False)])):
        log = ops(spark, [gone, *known])
        got = droppable(causal_present(M.as_merged(log), N), log, N).where("key = 'a'")
        assert [(r["key"], r["op"], r["drop"]) for r in got.collect()] == want
    log = ops(spark, [*both, *later])
    assert not any(r["drop"] for r in droppable(causal_present(M.as_merged(log), N), log, N).collect())
    assert droppable(causal_present(M.as_merged(log), N), log, N, before=0).where("drop").count() == 0


def test_the_latest_time_of_a_structure_stays_known(spark):
    log = [op(type="s", key="a", op="r", site=s, lts=lts) for s, lts in ((1, (1, 0, 0)), (2, (1, 1, 0)), (3, (1, 1, 1)), (1, (2, 1, 1)), (2, (2, 2, 1)), (3, (2, 2, 2)))]
    log.append(op(type="s", key="b", op="r", site=1, lts=(3, 2, 2)))
    log += [op(type="s", key=k, op="r", site=s, lts=lts) for k, s, lts in (("c", 2, (3, 3, 2)), ("d", 3, (3, 3, 3)))]
    log.append(op(type="s", key="e", op="r", site=1, lts=(4, 3, 3)))
    everyone = [(1, [4, 3, 3]), (2, [4, 4, 3]), (3, [4, 4, 4])]
    known = ops(spark, log + [op(type="s", key="f", op="r", site=s, lts=lts) for s, lts in everyone])
    now = causal_present(M.as_merged(known), N)
    left = compact(now, known, N).collect()
    assert len(left) < now.count() and [max(r["lts"][j] for r in left) for j in range(N)] == [4, 4, 4]


@pytest.mark.parametrize("seed", [1, 2])
def test_views_stay_before_and_after_later_operations(spark, seed):
    """Sites deliver in order, each as far as chance has it; the rest arrives after compaction."""
    log = [(*r[:2], "s", None, *r[4:]) for r in causal_log(seed, 220)]
    rng = random.Random(seed)
    cut = {s: rng.randrange(60, 220) for s in (1, 2, 3)}
    early = [r for i, r in enumerate(log) if i < cut[r[4]]]
    late = [r for i, r in enumerate(log) if i >= cut[r[4]]]
    known = ops(spark, early)
    now = causal_present(M.as_merged(known), N)
    small = compact(now, known, N)
    for view in VIEWS:
        assert rows(view(now)) == rows(view(small))
    after, small_after = (M.merge_ops(x, ops(spark, late), N) for x in (now, small))
    for view in VIEWS:
        assert rows(view(after)) == rows(view(small_after))


def test_empty_tables_and_unseen_structures(spark):
    none = ops(spark, [])
    assert compact(present(spark, []), none, N).count() == 0 and stable_clocks(none, N).count() == 0
    alone = present(spark, [op(op="r")])
    assert compact(alone, none, N).count() == 1
