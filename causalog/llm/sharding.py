"""Hilbert-curve sharding: rows near in several metadata columns share a shard.

Every dimension is quantised at its own quantiles, texts by whole strings, the cells are numbered along a
Hilbert curve, rows are sorted by that number and the order is cut into runs of equal
row count.  A reader with a box predicate skips the shards whose bounds miss the box.
"""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causalog.llm.common import column, written
from causalog.plans.scan import Running, prefix_scan, sorted_buckets


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points (n, dims) in [0, 2^bits).

    Gray-code form: from the top bit down, each axis' bit either exchanges or inverts
    the lower bits, then the bits of all axes are interleaved and Gray-decoded.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for axis in range(dims):
            flip = (x[axis] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[axis] ^= swap
    code = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            code = (code << 1) | ((x[axis] >> level) & 1)
    shift = 1
    while shift < bits * dims:  # Gray code to number
        code ^= code >> shift
        shift <<= 1
    return code


def _ordinal(df: DataFrame, name: str) -> Column:
    """An order-keeping number for a column, numbers and times as double; text as it is, in byte order."""
    kind = df.schema[name].dataType
    col = column(df, name)
    if isinstance(kind, T.StringType):
        return col
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    return col.cast("double")


def _text_cuts(values: DataFrame, bits: int) -> list[str]:
    """Quantiles of the one text column, whole strings: for every cut the least value with enough rows up to it.

    Counts of the distinct values and running totals in ranges; no more than 2^bits - 1 strings come back.
    """
    name = values.columns[0]
    counts = sorted_buckets(values.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0)), [name])
    total = counts.agg(F.sum("n")).first()[0]
    upto = prefix_scan(counts, ["all"], [name], F.col("__range"), {"upto": Running("sum", F.col("n"))}, levels=2)
    reached = F.floor(F.col("upto") * (1 << bits) / F.lit(total)), F.floor((F.col("upto") - F.col("n")) * (1 << bits) / F.lit(total))
    # The last of all values closes the last cell and cuts nothing.
    return sorted(r[0] for r in upto.where((reached[0] > reached[1]) & (reached[1] < (1 << bits) - 1)).select(name).collect())


def hilbert_shards(
    docs: DataFrame, dims: list[str], n_shards: int = 8, bits: int = 5, ties: list[Column] | None = None,
    payload: list[str] | None = None, accuracy: int = 10_000,
) -> DataFrame:
    """``payload`` columns (all by default) with curve, shard and slot, which replace columns so called.

    Shard row counts differ by at most one; ``slot`` counts from 0 within a shard.
    Rows of one cell are ordered by ``ties``.  Nulls take the lowest cell of their
    dimension; equal rows may stand in any order; an empty table gives an empty result.
    The sort is a range partition over (curve, ties), so a cell with very many rows is
    cut over several tasks; its order is fixed once, by writing the sorted rows.
    """
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if payload is None else payload) if c.lower() not in ("curve", "shard", "slot")]
    ties = ties or []
    base = docs.select(
        *[column(docs, c).alias(f"p{i}") for i, c in enumerate(kept)],
        *[_ordinal(docs, c).alias(f"d{i}") for i, c in enumerate(dims)],
        *[t.alias(f"t{i}") for i, t in enumerate(ties)],
    )
    # Cut points: 2^bits - 1 numbers per dimension, whatever the size of the table.
    points = [k / (1 << bits) for k in range(1, 1 << bits)]
    kinds = [base.schema[f"d{i}"].dataType for i in range(len(dims))]
    texts = [i for i, kind in enumerate(kinds) if isinstance(kind, T.StringType)]
    numbers = [F.percentile_approx(f"d{i}", points, accuracy).alias(f"c{i}") for i in range(len(dims)) if i not in texts]
    cuts = base.agg(*numbers).first().asDict() if numbers else {}
    cuts |= {f"c{i}": _text_cuts(base.select(f"d{i}"), bits) for i in texts}

    def cell(i: int) -> Column:
        edges = sorted(set(cuts[f"c{i}"] or []), key=lambda e: e.encode() if isinstance(e, str) else e)
        # How many cut points lie below the value, found by halving.
        def below(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(F.col(f"d{i}") > edges[mid], below(mid + 1, hi)).otherwise(below(lo, mid))
        return F.coalesce(below(0, len(edges)), F.lit(0))

    @F.pandas_udf("long")
    def curve(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy(), bits))

    keys = ["curve", *[f"t{i}" for i in range(len(ties))]]
    placed = base.withColumn("curve", curve(F.struct(*[cell(i).alias(f"c{i}") for i in range(len(dims))])))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = written(
        placed.select("curve", *[c for c in base.columns if c[0] != "d"])
        .repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .withColumn("at", F.monotonically_increasing_id())
    )
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # One row per sorted partition.
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    total = ordered.count()
    ranked = ordered.join(F.broadcast(offsets), part == F.col("part")).withColumn("rank", F.col("offset") + within)
    # Shard s holds the ranks from ceil(s * total / n_shards) on.
    shard = F.expr(f"CAST(rank * {n_shards} div {max(total, 1)} AS INT)")
    first = F.expr(f"(shard * CAST({total} AS BIGINT) + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("shard", shard).select(
        *[F.col(f"p{i}").alias(c) for i, c in enumerate(kept)],
        "curve", "shard", (F.col("rank") - first).alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, each in curve order, so that files and row groups prune.

    The ranges of ``hilbert_shards`` are already in order; sorting inside the write's
    tasks keeps that order within every file.
    """
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_bounds(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Per shard the least and greatest value of each dimension, and whether it has nulls."""
    aggs = [f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))]
    nulls = [F.max(F.col(c).isNull()).alias(f"null_{c}") for c in dims]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *aggs, *nulls)


def matching_shards(bounds: DataFrame, box: dict[str, tuple]) -> DataFrame:
    """The shards that can hold rows with low <= column <= high for every column of ``box``."""
    hit = reduce(lambda a, b: a & b, [(F.col(f"max_{c}") >= lo) & (F.col(f"min_{c}") <= hi) for c, (lo, hi) in box.items()], F.lit(True))
    return bounds.where(hit).select("shard")
