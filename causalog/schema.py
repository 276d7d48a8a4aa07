"""Column layouts shared by every operator."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Structure types and operation kinds a log may contain.
STRUCTURE_TYPES = ("r", "s", "m", "c", "l")
OPERATION_KINDS = ("a", "r")

PTS = T.StructType([
    T.StructField("physical_time", T.LongType()),
    T.StructField("logical_time", T.IntegerType()),
])
LTS = T.ArrayType(T.LongType())

_PAYLOAD = [
    T.StructField("id", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("site", T.IntegerType()),
    T.StructField("lts", LTS),
    T.StructField("pts", PTS),
    T.StructField("op", T.StringType()),
]
OP = T.StructType(_PAYLOAD + [
    T.StructField("seq", T.LongType()),
    T.StructField("hops", T.IntegerType()),
    T.StructField("arrival_time", T.LongType()),
])
PRESENT = T.StructType(_PAYLOAD + [T.StructField("merged_at", T.LongType())])

PAYLOAD_COLUMNS = [f.name for f in _PAYLOAD]
PRESENT_COLUMNS = [f.name for f in PRESENT.fields]
OP_COLUMNS = [f.name for f in OP.fields]


def is_valid_op(n_sites: int) -> Column:
    """True for a row every operator can work with; never NULL."""
    return F.coalesce(
        F.col("id").isNotNull()
        & F.col("key").isNotNull()
        & F.col("type").isin(*STRUCTURE_TYPES)
        & F.col("op").isin(*OPERATION_KINDS)
        & F.col("site").between(1, n_sites)
        & (F.size("lts") <= n_sites),
        F.lit(False),
    )


def split_rejects(df: DataFrame, n_sites: int) -> tuple[DataFrame, DataFrame]:
    """Split rows into (valid, rejects); together they are the whole input."""
    ok = is_valid_op(n_sites)
    return df.where(ok), df.where(~ok)
