"""Batch look-ups: a probe DataFrame in place of one call per structure.

Probes keep their row even when the structure does not exist; the answer is then
NULL, or False for a containment test.  All of them are equi-joins on the probe's
columns, so Spark may broadcast a small probe side by its measured size.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalog.operators import resolve as R
from causalog.plans.scan import row_numbers, sorted_buckets

_REGISTER = {"mvr": R.register_mvr, "lww": R.register_lww}
_SET = {"aw": R.set_aw, "rw": R.set_rw, "lww": R.set_lww}
_SET_TUPLE = {"aw": R.set_aw_tuple, "rw": R.set_rw_tuple, "lww": R.set_lww_tuple}
_MAP = {"aw_mvr": R.map_aw_mvr, "aw_lww": R.map_aw_lww, "rw_mvr": R.map_rw_mvr, "lww": R.map_lww}
_MAP_TUPLE = {
    "aw_mvr": R.map_aw_mvr_tuple, "aw_lww": R.map_aw_lww_tuple,
    "rw_mvr": R.map_rw_mvr_tuple, "lww": R.map_lww_tuple,
}


def _rule(rules: dict, mode: str):
    if mode not in rules:
        raise ValueError(f"unknown rule {mode!r}; expected one of {sorted(rules)}")
    return rules[mode]


def _get(ids: DataFrame, view: DataFrame) -> DataFrame:
    return ids.join(view, "id", "left")


def _contains(probes: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    found = members.select(*keys).withColumn("__hit", F.lit(True))
    joined = probes.join(found, keys, "left")
    return joined.select(*probes.columns, F.coalesce("__hit", F.lit(False)).alias("contains"))


def register_get(ids: DataFrame, present: DataFrame, mode: str = "lww") -> DataFrame:
    return _get(ids, _rule(_REGISTER, mode)(present))


def set_get(ids: DataFrame, present: DataFrame, mode: str = "aw") -> DataFrame:
    return _get(ids, _rule(_SET_TUPLE, mode)(present))


def set_contains(probes: DataFrame, present: DataFrame, mode: str = "aw") -> DataFrame:
    """Probes (id, elem)."""
    members = _rule(_SET, mode)(present).withColumnRenamed("data", "elem")
    return _contains(probes, members, ["id", "elem"])


def map_get(ids: DataFrame, present: DataFrame, mode: str = "lww") -> DataFrame:
    return _get(ids, _rule(_MAP_TUPLE, mode)(present))


def _entries(present: DataFrame, mode: str) -> DataFrame:
    return _rule(_MAP, mode)(present).select("id", "data.key", "data.value")


def map_value(probes: DataFrame, present: DataFrame, mode: str = "lww") -> DataFrame:
    """Probes (id, key)."""
    return probes.join(_entries(present, mode), ["id", "key"], "left")


def map_contains(probes: DataFrame, present: DataFrame, mode: str = "lww") -> DataFrame:
    """Probes (id, key)."""
    return _contains(probes, _entries(present, mode), ["id", "key"])


def counter_get(ids: DataFrame, present: DataFrame) -> DataFrame:
    return _get(ids, R.counter(present))


def counter_get_all(present: DataFrame) -> DataFrame:
    return R.counter(present)


def counter_get_multiple(ids: DataFrame, present: DataFrame) -> DataFrame:
    """Counters named in ``ids``; names without a counter give no row."""
    return R.counter(present.join(ids.select("id"), "id", "left_semi"))


def list_get(ids: DataFrame, present: DataFrame) -> DataFrame:
    return _get(ids, R.list_tuple(present))


def list_ranks(present: DataFrame) -> DataFrame:
    """Live list elements with their zero-based index.

    Elements are range-partitioned by (structure, position), so one very long list is
    numbered by many tasks.
    """
    live = present.where("type = 'l' and op != 'r'").select(
        "id", F.col("key").alias("pos"), "data", "site",
        (-F.col("pts.physical_time")).alias("__p"), (-F.col("pts.logical_time")).alias("__l"),
    )
    order = ["pos", "site", "__p", "__l"]
    ranged = sorted_buckets(live, ["id", *order])
    numbered = row_numbers(ranged, ["id"], order, F.col("__range"), "__n")
    return numbered.select("id", "pos", "data", (F.col("__n") - 1).alias("index"))


def list_get_at(probes: DataFrame, present: DataFrame) -> DataFrame:
    """Probes (id, index), index counted from zero."""
    at = list_ranks(present).select("id", "index", "data")
    return probes.withColumn("index", F.col("index").cast("long")).join(at, ["id", "index"], "left")


def _end(ids: DataFrame, present: DataFrame, pick) -> DataFrame:
    # The order of list_ranks: rows that share a position are told apart by site, newest first.
    order = F.struct("key", "site", -F.col("pts.physical_time"), -F.col("pts.logical_time"))
    live = present.where("type = 'l' and op != 'r'")
    ends = live.groupBy("id").agg(pick(F.struct("data"), order).alias("__e"))
    return _get(ids, ends.select("id", F.col("__e.data").alias("data")))


def list_first(ids: DataFrame, present: DataFrame) -> DataFrame:
    return _end(ids, present, F.min_by)


def list_last(ids: DataFrame, present: DataFrame) -> DataFrame:
    return _end(ids, present, F.max_by)


