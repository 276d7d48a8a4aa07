"""Compaction queries: sets over short windows, so that sites soon see each other's removes."""

from functools import reduce

from pyspark.sql import functions as F

from causalog.operators import resolve as R
from causalog.operators.compaction import compact, droppable
from causalog.operators.merge import merge_ops
from causalog.session import stable
from causalog.sources.recipes import N_SITES
from workload.spark_base import log, table
from workload.sql_parts import VIEW_SQL, frontier_cte, with_log
from workload.views import _HALF, _LOCAL, _halves

SPARK, SQL = {}, {}
WINDOW = 64
_VIEWS = ("set_aw", "set_rw", "set_lww")


def query(name, sql):
    def register(fn):
        SPARK[name], SQL[name] = fn, sql
        return fn
    return register


def _early(spark, sf_dir):
    """The present of the first half of the log, the rows known then, and the rest."""
    local, late = _halves(spark, sf_dir, "s", WINDOW)
    top = table(spark, sf_dir, "events").agg(F.floor(F.max("event_id") / 2)).scalar()
    return stable(local), log(spark, sf_dir, "s", WINDOW).where(F.col("seq") <= top), late


_SEEN = f"""seen AS (SELECT id, site, {", ".join(f"max(lts[{s}]) AS s{s}" for s in (1, 2, 3))} FROM early GROUP BY id, site),
steady AS (SELECT id, {", ".join(f"CASE WHEN count(*) = 3 THEN min(s{s}) ELSE 0 END AS m{s}" for s in (1, 2, 3))} FROM seen GROUP BY id)"""


@query("stable_removes", with_log("s", """
SELECT l.id, l.key, l.site, l.op, l.op = 'r' AND l.lts[1] <= m1 AND l.lts[2] <= m2 AND l.lts[3] <= m3
  AND NOT EXISTS (SELECT 1 FROM loc a WHERE a.id = l.id AND a.key = l.key AND a.op = 'a') AS drop
FROM loc l JOIN steady USING (id)""", WINDOW, f"{_LOCAL}, {_SEEN}"))
def stable_removes(spark, sf_dir):
    local, known, _ = _early(spark, sf_dir)
    return droppable(local, known, N_SITES).select("id", "key", "site", "op", "drop")


@query("compacted_views", with_log("s", " UNION ALL ".join(
    f"SELECT '{stage}' AS stage, '{view}' AS view, id, data FROM ({VIEW_SQL[view][1].replace('FROM cur', f'FROM {rows}')})"
    for stage, rows in (("now", "loc"), ("later", "cur")) for view in _VIEWS), WINDOW, f"{_LOCAL}, {frontier_cte()}"))
def compacted_views(spark, sf_dir):
    """Views of the compacted present, now and after the rest of the log; the SQL compacts nothing."""
    local, known, late = _early(spark, sf_dir)
    small = stable(compact(local, known, N_SITES))
    stages = {"now": small, "later": stable(merge_ops(small, late, N_SITES, "causal"))}
    return reduce(lambda a, b: a.unionByName(b), [
        getattr(R, view)(rows).select(F.lit(stage).alias("stage"), F.lit(view).alias("view"), "id", "data")
        for stage, rows in stages.items() for view in _VIEWS])
