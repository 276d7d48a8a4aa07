"""Merging received operations into the materialised present.

Merging is commutative, associative and idempotent: arrival order, replays and the
cut into batches do not change the result.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalog.functions.clocks import vc_lt, vc_lte
from causalog.operators.present import causal_present, same_element
from causalog.schema import PRESENT_COLUMNS

# Fixed value: hops after which an operation is not forwarded any more.
MAX_HOPS = 3


def _identity(ops: DataFrame) -> DataFrame:
    return ops.select("id", "key", "lts")


def drop_obsolete(batch: DataFrame, present: DataFrame, n_sites: int) -> DataFrame:
    """Batch rows the present neither contains nor supersedes."""
    newer = same_element("b", "p") & vc_lte("b.lts", "p.lts", n_sites)
    return batch.alias("b").join(_identity(present).alias("p"), newer, "left_anti")


def superseded(present: DataFrame, batch: DataFrame, n_sites: int, mode: str = "exact") -> DataFrame:
    """Present rows strictly below some batch row.

    Whatever a batch row supersedes, a maximal batch row supersedes too, so only the
    batch's own frontier takes part in the join.
    """
    top = causal_present(batch, n_sites, mode=mode)
    older = same_element("p", "b") & vc_lt("p.lts", "b.lts", n_sites)
    return present.alias("p").join(_identity(top).alias("b"), older, "left_semi")


def as_merged(batch: DataFrame) -> DataFrame:
    """Log rows in the present's layout; the merge time is the arrival time."""
    return batch.withColumn("merged_at", F.col("arrival_time")).select(*PRESENT_COLUMNS)


def merge_ops(present: DataFrame, batch: DataFrame, n_sites: int, mode: str = "exact") -> DataFrame:
    """The new present.  Removes stay as tombstones."""
    both = present.select(*PRESENT_COLUMNS).unionByName(as_merged(batch))
    return causal_present(both, n_sites, mode=mode)


def receive_ops(
    batch: DataFrame, local_site: int, present: DataFrame, log: DataFrame, now_ms: int, n_sites: int
) -> DataFrame:
    """Log rows for a batch received from other sites.

    Known operations are dropped (superseded by the present, or already in the log, or
    repeated inside the batch); foreign ones gain a hop; arrival becomes ``now_ms``.
    """
    fresh = drop_obsolete(batch, present, n_sites)
    fresh = fresh.join(_identity(log), ["id", "key", "lts"], "left_anti").select(*batch.columns)
    rest = [c for c in batch.columns if c not in ("id", "key", "lts")]
    order = F.struct(F.col("hops"), F.col("seq"), F.xxhash64(*rest).alias("h"))
    once = fresh.groupBy("id", "key", "lts").agg(F.min_by(F.struct(*rest), order).alias("__r"))
    rows = once.select(*[F.col(f"__r.{c}").alias(c) if c in rest else F.col(c) for c in batch.columns])
    foreign = F.col("site") != local_site
    return rows.withColumns({
        "hops": F.when(foreign, F.col("hops") + 1).otherwise(F.col("hops")),
        "arrival_time": F.lit(now_ms).cast("long"),
    })


def forwardable(ops: DataFrame, ttl: int = MAX_HOPS, next_site: int | None = None) -> DataFrame:
    """Rows to send on: below the hop limit, or on a ring all but the receiver's own."""
    if next_site is not None:
        return ops.where(F.col("site") != next_site)
    return ops.where(F.col("hops") < ttl)


def wall_clock(ops: DataFrame) -> DataFrame:
    """Last physical time seen from each site."""
    return ops.groupBy("site").agg(F.max("pts.physical_time").alias("physical_time"))


def unmerged(log: DataFrame, present: DataFrame, n_sites: int) -> DataFrame:
    """Log rows the present does not cover yet."""
    return drop_obsolete(log, present, n_sites)


def backlog(log: DataFrame, present: DataFrame, n_sites: int) -> DataFrame:
    """Unmerged rows per site."""
    return unmerged(log, present, n_sites).groupBy("site").agg(F.count("*").alias("unmerged"))


def fully_merged(log: DataFrame, present: DataFrame, n_sites: int) -> DataFrame:
    """One row: is the backlog empty?"""
    return unmerged(log, present, n_sites).agg((F.count("*") == 0).alias("fully_merged"))


