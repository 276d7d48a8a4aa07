"""Replica audit: convergence, missing operations, causality, open conflicts."""


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalog.functions.clocks import coord, vc_lte

IDENTITY = ("id", "key", "site", "lts")


def _fingerprint() -> list[Column]:
    """Order-free digest of a group of rows: two independent sums and a count."""
    row = ["id", "key", "type", "data", "site", "lts", "pts", "op"]
    sums = [
        F.sum(F.xxhash64(F.lit(salt), *[F.col(c) for c in row]).cast("decimal(38,0)")).alias(f"__h{salt}")
        for salt in (1, 2)
    ]
    return [*sums, F.count("*").alias("__n")]


def converged(replicas: DataFrame, n_replicas: int, replica: str = "replica") -> DataFrame:
    """Per structure: do all replicas hold the same rows?

    ``replicas`` is the union of the presents with a column naming the holder.  A
    replica without any row of a structure disagrees with those that have some.
    """
    digests = replicas.groupBy(replica, "id").agg(*_fingerprint())
    agree = (F.count("*") == n_replicas) & (
        F.count_distinct(F.struct("__h1", "__h2", "__n")) == 1
    )
    return digests.groupBy("id").agg(agree.alias("converged"))


def missing_ops(have: DataFrame, lack: DataFrame) -> DataFrame:
    """Operations in ``have`` that ``lack`` does not know."""
    return have.join(lack.select(*IDENTITY), list(IDENTITY), "left_anti")


def check_causal(ops: DataFrame, n_sites: int) -> DataFrame:
    """Rows that break causal consistency, with the reason.

    Per (structure, site) the own coordinate must count 1, 2, 3, ... and the clock may
    never go back in any coordinate.  One clear writes several removes with one clock;
    that is the only allowed repeat.  The predecessor of own value n is the row with
    n - 1, found by an equi-join, so no structure or site is ordered in one task.
    """
    own = coord("lts", F.col("site"))
    steps = ops.groupBy("id", "site", own.alias("own")).agg(
        F.min("lts").alias("low"), F.max("lts").alias("high"), F.count("*").alias("n"),
        F.max(F.col("op") != "r").alias("adds"),
    )
    before = steps.select("id", "site", (F.col("own") + 1).alias("own"), F.col("high").alias("prev"))
    seen = steps.join(before, ["id", "site", "own"], "left")
    reason = (
        F.when((F.col("low") != F.col("high")) | ((F.col("n") > 1) & F.col("adds")), "repeat")
        .when(F.col("own") < 1, "own")
        .when((F.col("own") > 1) & F.col("prev").isNull(), "gap")
        .when(F.col("prev").isNotNull() & ~vc_lte("prev", "low", n_sites), "regress")
    )
    return seen.select("id", "site", "own", reason.alias("reason")).where("reason is not null")


def conflicts(present: DataFrame) -> DataFrame:
    """Elements with more than one surviving operation, and which kinds meet."""
    adds = F.count(F.when(F.col("op") == "a", 1))
    removes = F.count(F.when(F.col("op") == "r", 1))
    rows = present.groupBy("type", "id", "key").agg(adds.alias("adds"), removes.alias("removes"))
    kind = (
        F.when((F.col("adds") > 0) & (F.col("removes") > 0), "add/remove")
        .when(F.col("adds") > 1, "add/add")
        .otherwise("remove/remove")
    )
    return rows.where("adds + removes > 1").withColumn("kind", kind)


