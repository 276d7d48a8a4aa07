"""Dropping removes that nothing can need any more.

A remove that every site has seen is *stable*: whatever a site writes on the structure
from then on supersedes it.  What a site has seen is the pointwise maximum of the clocks
it wrote, so operations of one site must arrive in the order they were written.  Rows
that carry the latest known time of a structure stay, so that clocks go on from there.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalog.functions.clocks import coord
from causalog.operators.present import join_null_safe


def stable_clocks(ops: DataFrame, n_sites: int) -> DataFrame:
    """Per structure the pointwise minimum of what every site has seen: (id, stable).

    ``ops`` are all rows known, merged or not.  A site that never wrote on a structure has seen nothing of it.
    """
    seen = ops.groupBy("id", "site").agg(*[F.max(coord("lts", s)).alias(f"s{s}") for s in range(1, n_sites + 1)])
    everyone = F.count(F.lit(1)) == n_sites
    least = F.array(*[F.when(everyone, F.min(f"s{s}")).otherwise(0).cast("long") for s in range(1, n_sites + 1)])
    return seen.groupBy("id").agg(least.alias("stable"))


def droppable(present: DataFrame, ops: DataFrame, n_sites: int, before: int | None = None) -> DataFrame:
    """Rows of ``present`` with ``drop``: a stable remove of an element that no add is left of.

    A remove beside a concurrent add decides between the rules and stays.  ``before`` (epoch
    ms) spares younger removes, for sites that lag behind in delivery.
    """
    adds = present.groupBy("id", "key").agg(F.max((F.col("op") != "r").cast("int")).alias("__adds"))
    rows = join_null_safe(join_null_safe(present, adds, ["id", "key"]), stable_clocks(ops, n_sites), ["id"], "left")
    old = F.lit(True) if before is None else F.coalesce(F.col("pts.physical_time") < before, F.lit(False))
    covered = F.lit(True)
    for s in range(1, n_sites + 1):
        covered &= coord("lts", s) <= F.coalesce(F.get("stable", F.lit(s - 1)), F.lit(0))
    drop = (F.col("op") == "r") & (F.col("__adds") == 0) & covered & old
    return rows.select(*present.columns, F.coalesce(drop, F.lit(False)).alias("drop"))


def compact(present: DataFrame, ops: DataFrame, n_sites: int, before: int | None = None) -> DataFrame:
    """``present`` without stable removes; every view, now and after later operations, is as before.

    ``ops`` are all rows known, the present's own included.
    """
    rows = droppable(present, ops, n_sites, before)
    # One row per structure and site keeps the latest known time, where no row that stays has it.
    who = F.struct("key", "site", "lts")
    gone, sites = F.col("drop"), range(1, n_sites + 1)
    tops = rows.groupBy("id").agg(*[
        F.when(F.max(F.when(gone, coord("lts", s))) > F.coalesce(F.max(F.when(~gone, coord("lts", s))), F.lit(0)),
               F.max_by(F.when(gone, who), F.when(gone, F.struct(coord("lts", s).alias("c"), who.alias("w"))))).alias(f"w{s}") for s in sites])
    kept = tops.select("id", F.explode(F.array_distinct(F.array_compact(F.array(*[f"w{s}" for s in sites])))).alias("w")).select("id", "w.*", F.lit(True).alias("__kept"))
    marked = join_null_safe(rows, kept, ["id", "key", "site", "lts"], "left")
    return marked.where(~F.col("drop") | F.col("__kept").isNotNull()).select(*present.columns)
