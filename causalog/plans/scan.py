"""Running aggregates over ordered groups that may be too large for one task.

A window with ``partitionBy(group)`` sends a whole group to one task.  Here rows are
cut into ordered buckets first: each bucket runs its own window, one small row per
bucket carries its total, and the totals of the earlier buckets are joined back.  A
single hot group therefore spreads over as many tasks as it has buckets.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalog.session import stable

BUCKET = "__bucket"
FANOUT = 4096


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``kind`` is sum, max, min or last (last non-NULL)."""

    kind: str
    value: Column
    inclusive: bool = True


def _window_agg(kind: str, col: Column, window) -> Column:
    if kind == "last":
        return F.last(col, ignorenulls=True).over(window)
    return getattr(F, kind)(col).over(window)


def _total_agg(kind: str, col: Column, order: list[Column], reverse: bool) -> Column:
    if kind != "last":
        return getattr(F, kind)(col)
    pick = F.min_by if reverse else F.max_by
    return pick(col, F.when(col.isNotNull(), F.struct(*order)))


def _combine(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
    if kind == "max":
        return F.greatest(before, here)
    if kind == "min":
        return F.least(before, here)
    return F.coalesce(here, before)


def prefix_scan(
    df: DataFrame,
    group: list[str],
    order: list[str],
    bucket: Column,
    running: dict[str, Running],
    reverse: bool = False,
    levels: int = 1,
) -> DataFrame:
    """Add running aggregates over (group, ordered by order).

    Group columns must not be NULL, and ``bucket`` must be a deterministic non-NULL long expression that never decreases
    along ``order``.  ``reverse`` scans from the end.  With ``levels`` above one the
    bucket totals are scanned the same way, so even a group of very many (sparse)
    buckets is not gathered in one task.
    """
    values = {f"__v_{name}": spec.value for name, spec in running.items()}
    src = df.withColumns({BUCKET: bucket.cast("long"), **values})
    keys = group + [BUCKET]

    direction = [F.desc(c) if reverse else F.asc(c) for c in order]
    whole = Window.partitionBy(*keys).orderBy(*direction)
    frames = {
        True: whole.rowsBetween(Window.unboundedPreceding, 0),
        False: whole.rowsBetween(Window.unboundedPreceding, -1),
    }
    local = src.withColumns({
        f"__l_{name}": _window_agg(spec.kind, F.col(f"__v_{name}"), frames[spec.inclusive])
        for name, spec in running.items()
    })

    totals = src.groupBy(*keys).agg(*[
        _total_agg(spec.kind, F.col(f"__v_{name}"), [F.col(c) for c in order], reverse).alias(f"__t_{name}")
        for name, spec in running.items()
    ])
    if levels > 1:
        renamed = totals.withColumnRenamed(BUCKET, "__b")
        offsets = prefix_scan(
            renamed, group, ["__b"], F.floor(F.col("__b") / FANOUT),
            {f"__o_{name}": Running(spec.kind, F.col(f"__t_{name}"), False) for name, spec in running.items()},
            reverse, levels - 1,
        ).withColumnRenamed("__b", BUCKET)
    else:
        by_bucket = F.desc(BUCKET) if reverse else F.asc(BUCKET)
        before = Window.partitionBy(*group).orderBy(by_bucket).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.withColumns({
            f"__o_{name}": _window_agg(spec.kind, F.col(f"__t_{name}"), before)
            for name, spec in running.items()
        })
    offsets = offsets.select(*keys, *[f"__o_{name}" for name in running])

    # Same keys as the window above: the rows are not shuffled again for this join.
    joined = local.join(offsets, keys, "left")
    kept = [F.col(c) for c in df.columns if c not in running]
    return joined.select(
        *kept,
        *[_combine(spec.kind, F.col(f"__o_{name}"), F.col(f"__l_{name}")).alias(name) for name, spec in running.items()],
    )


def row_numbers(df: DataFrame, group: list[str], order: list[str], bucket: Column, name: str, levels: int = 1) -> DataFrame:
    """1-based position of each row in its group, without one window per group."""
    return prefix_scan(df, group, order, bucket, {name: Running("sum", F.lit(1).cast("long"))}, levels=levels)


def sorted_buckets(df: DataFrame, order: list[str], name: str = "__range") -> DataFrame:
    """Sort-range every row by ``order`` and record which range it fell in.

    For sort columns without a usable numeric bucket (strings).  Range bounds come
    from Spark's sampling, so the rows are written once to the checkpoint folder and
    all later branches see the same ranges.  Equal keys always share a range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id().cast("long"))
    return stable(ranged)
