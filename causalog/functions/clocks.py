"""Vector and hybrid clocks as plain column expressions.

Where the number of sites is known the comparisons unroll into one boolean chain,
which Spark compiles into the surrounding stage; otherwise they fall back to
higher-order functions.  Missing coordinates count as zero.
"""

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


def coord(lts: ColumnOrName, site: Column | int) -> Column:
    """Coordinate of a 1-based site, zero when the clock is too short."""
    index = site - 1 if isinstance(site, int) else (site - F.lit(1)).cast("int")
    return F.coalesce(F.get(_c(lts), index), F.lit(0).cast("long"))


def vc_lte(a: ColumnOrName, b: ColumnOrName, n_sites: int | None = None) -> Column:
    """a happened at or before b: every coordinate of a is <= that of b."""
    a, b = _c(a), _c(b)
    if n_sites is not None:
        chain = reduce(and_, [coord(a, s) <= coord(b, s) for s in range(1, n_sites + 1)])
        return F.when(a.isNotNull() & b.isNotNull(), chain)
    zero = F.lit(0).cast("long")
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x, zero) <= F.coalesce(y, zero))
    return F.forall(pairs, lambda ok: ok)


def vc_eq(a: ColumnOrName, b: ColumnOrName, n_sites: int | None = None) -> Column:
    return vc_lte(a, b, n_sites) & vc_lte(b, a, n_sites)


def vc_lt(a: ColumnOrName, b: ColumnOrName, n_sites: int | None = None) -> Column:
    """a happened strictly before b."""
    return vc_lte(a, b, n_sites) & ~vc_lte(b, a, n_sites)


def vc_concurrent(a: ColumnOrName, b: ColumnOrName, n_sites: int | None = None) -> Column:
    return ~vc_lte(a, b, n_sites) & ~vc_lte(b, a, n_sites)


def vc_max(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Pointwise maximum; the shorter clock is padded."""
    zero = F.lit(0).cast("long")
    return F.zip_with(_c(a), _c(b), lambda x, y: F.greatest(F.coalesce(x, zero), F.coalesce(y, zero)))


def vc_zero(n_sites: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), n_sites)


def vc_pad(lts: ColumnOrName, n_sites: int) -> Column:
    """The clock with exactly n_sites coordinates."""
    return F.slice(F.concat(_c(lts), vc_zero(n_sites)), 1, n_sites)


def vc_inc(lts: ColumnOrName, site: Column | int, by: Column | int = 1) -> Column:
    """The clock advanced at one site."""
    at = (F.lit(site) if isinstance(site, int) else site) - F.lit(1)
    by = F.lit(by) if isinstance(by, int) else by
    return F.transform(_c(lts), lambda x, i: F.when(i == at, x + by.cast("long")).otherwise(x))


def vc_sum(lts: ColumnOrName, n_sites: int) -> Column:
    """Sum of coordinates: strictly larger whenever a clock strictly dominates."""
    return reduce(add, [coord(lts, s).cast("decimal(38,0)") for s in range(1, n_sites + 1)])


def vc_max_columns(lts: ColumnOrName, n_sites: int) -> Column:
    """Aggregate expression: pointwise maximum over a group."""
    return F.array(*[F.max(coord(lts, s)) for s in range(1, n_sites + 1)])


def vc_max_agg(df: DataFrame, keys: list[str], n_sites: int, lts: str = "lts") -> DataFrame:
    """Current time per group.  Plain max aggregates, so partial sums run map-side."""
    return df.groupBy(*keys).agg(vc_max_columns(lts, n_sites).alias("lts"))


def hlc(physical: Column, logical: Column) -> Column:
    return F.struct(physical.cast("long").alias("physical_time"), logical.cast("int").alias("logical_time"))


def hlc_order(pts: ColumnOrName) -> Column:
    """Sortable form of a hybrid clock: physical time first, then logical."""
    pts = _c(pts)
    return F.struct(pts["physical_time"].alias("physical_time"), pts["logical_time"].alias("logical_time"))


def hlc_next(current: ColumnOrName, wall_ms: Column) -> Column:
    """One step of a hybrid clock from the last value and a wall-clock reading."""
    current = _c(current)
    advanced = wall_ms > current["physical_time"]
    return F.when(advanced, hlc(wall_ms, F.lit(1))).otherwise(
        hlc(current["physical_time"], current["logical_time"] + 1)
    )
