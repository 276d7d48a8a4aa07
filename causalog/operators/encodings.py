"""Other encodings of a vector clock, each convertible to and from the array form.

rows: one row per (k, tid, site); json: {"1": n, ...}; box: a lower corner (k, 0, ..)
and an upper corner (k, clock).  Every encoding shares one causal-present operator.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalog.functions.clocks import coord, vc_max_agg
from causalog.operators.present import causal_present

# encoders keep the payload and replace (or split) the clock


def clock_to_rows(df: DataFrame, key: str = "k", tid: str = "tid", lts: str = "lts") -> DataFrame:
    return df.select(key, tid, F.posexplode(lts).alias("__p", "lts")).select(
        key, tid, (F.col("__p") + 1).cast("int").alias("site"), "lts"
    )


def rows_to_clock(rows: DataFrame, n_sites: int, key: str = "k", tid: str = "tid") -> DataFrame:
    """Back to arrays; a missing coordinate is zero."""
    at = [F.coalesce(F.max(F.when(F.col("site") == s, F.col("lts"))), F.lit(0)) for s in range(1, n_sites + 1)]
    return rows.groupBy(key, tid).agg(F.array(*at).alias("lts"))


def clock_to_json(lts: str, n_sites: int) -> Column:
    pairs = [item for s in range(1, n_sites + 1) for item in (F.lit(str(s)), coord(lts, s))]
    return F.to_json(F.create_map(*pairs))


def json_to_clock(text: str, n_sites: int) -> Column:
    parsed = F.from_json(F.col(text), "map<string,bigint>")
    return F.array(*[F.coalesce(F.try_element_at(parsed, F.lit(str(s))), F.lit(0)) for s in range(1, n_sites + 1)])


def clock_to_box(key: str, lts: str, n_sites: int) -> Column:
    zero = F.lit(0).cast("long")
    k = F.col(key).cast("long")
    low = F.array(k, *[zero for _ in range(n_sites)])
    high = F.array(k, *[coord(lts, s) for s in range(1, n_sites + 1)])
    return F.struct(low.alias("lo"), high.alias("hi"))


def box_to_clock(box: str, n_sites: int) -> Column:
    return F.slice(F.col(f"{box}.hi"), 2, n_sites)


def box_contains(outer: str, inner: str, n_sites: int) -> Column:
    """The inner box lies within the outer one: the clock order, plus equal keys."""
    o, i = F.col(outer), F.col(inner)
    sides = [
        (F.get(o["lo"], d) <= F.get(i["lo"], d)) & (F.get(i["hi"], d) <= F.get(o["hi"], d))
        for d in range(n_sites + 1)
    ]
    return reduce(and_, sides)


def encode(df: DataFrame, encoding: str, n_sites: int) -> DataFrame:
    """(k, v, lts array, ...) with the clock column in another encoding."""
    if encoding == "array":
        return df
    if encoding == "json":
        return df.withColumn("lts", clock_to_json("lts", n_sites))
    if encoding == "box":
        return df.withColumn("lts", clock_to_box("k", "lts", n_sites))
    raise ValueError(f"unknown encoding {encoding!r}")


def decode(df: DataFrame, encoding: str, n_sites: int, rows: DataFrame | None = None) -> DataFrame:
    """The array form.  The rows encoding takes the clock table as ``rows``."""
    if encoding == "array":
        return df
    if encoding == "json":
        return df.withColumn("lts", json_to_clock("lts", n_sites))
    if encoding == "box":
        return df.withColumn("lts", box_to_clock("lts", n_sites))
    if encoding == "rows":
        return df.join(rows_to_clock(rows, n_sites), ["k", "tid"])
    raise ValueError(f"unknown encoding {encoding!r}")


def causal_present_encoded(
    df: DataFrame,
    encoding: str,
    n_sites: int,
    rows: DataFrame | None = None,
    k=None,
    mode: str = "exact",
) -> DataFrame:
    """Present per key ``k``; give ``k`` to read one key, else all.

    A key with a single version keeps it.
    """
    if k is not None:
        df = df.where(F.col("k") == k)
        rows = rows.where(F.col("k") == k) if rows is not None else None
    return causal_present(decode(df, encoding, n_sites, rows), n_sites, keys=("k",), mode=mode)


def current_clock(df: DataFrame, encoding: str, n_sites: int) -> DataFrame:
    """Pointwise maximum per key.  For the rows encoding ``df`` is the clock table."""
    if encoding == "rows":
        per_site = df.groupBy("k", "site").agg(F.max("lts").alias("lts")).withColumn("tid", F.lit(0))
        return rows_to_clock(per_site, n_sites).drop("tid")
    return vc_max_agg(decode(df, encoding, n_sites), ["k"], n_sites)


def site_clock(ops: DataFrame, site: int, key: str = "k", lts: str = "lts") -> DataFrame:
    """Latest clock one site holds per key: the one with its largest own coordinate."""
    order = F.struct(coord(lts, site).alias("own"), F.col(lts).alias("clock"))
    return ops.groupBy(key).agg(F.max_by(F.col(lts), order).alias("lts"))
