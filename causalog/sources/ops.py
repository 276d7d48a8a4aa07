"""Reading, writing and generating operation logs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalog.functions.clocks import hlc, vc_inc, vc_zero
from causalog.schema import OP, OP_COLUMNS, PAYLOAD_COLUMNS, split_rejects

# Elements generated by one task; larger structures are split over several.
ENTRIES_PER_TASK = 100_000


def read_ops(spark: SparkSession, path: str, n_sites: int) -> tuple[DataFrame, DataFrame]:
    """Scan an operation log; returns (valid rows, rejected rows)."""
    return split_rejects(spark.read.schema(OP).parquet(path), n_sites)


def read_ops_stream(
    spark: SparkSession, path: str, n_sites: int, max_files: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The same log as unbounded streams of newly written files: (valid rows, rejected rows)."""
    reader = spark.readStream.schema(OP)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return split_rejects(reader.parquet(path), n_sites)


def with_log_defaults(df: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Fill the columns the log adds to an operation: seq, hops and arrival time."""
    arrival = F.col("pts.physical_time") if now_ms is None else F.lit(now_ms)
    defaults = {"seq": F.lit(None).cast("long"), "hops": F.lit(0), "arrival_time": arrival.cast("long")}
    missing = {name: col for name, col in defaults.items() if name not in df.columns}
    return df.withColumns(missing).select(*OP_COLUMNS)


def append_ops(df: DataFrame, path: str, now_ms: int | None = None) -> None:
    with_log_defaults(df, now_ms).write.mode("append").parquet(path)


def clone_structure(present: DataFrame, id: str, prefix: str, copies: int) -> DataFrame:
    """Copy one structure ``copies`` times as prefix1, prefix2, ..."""
    rows = present.where(F.col("id") == id)
    numbers = F.explode(F.sequence(F.lit(1), F.lit(copies)))
    if copies < 1:
        return rows.limit(0)
    numbered = rows.select(numbers.alias("__i"), *present.columns)
    return numbered.withColumn("id", F.concat(F.lit(prefix), F.col("__i").cast("string"))).select(*present.columns)


def filter_like(view: DataFrame, pattern: str, column: str = "id") -> DataFrame:
    return view.where(F.col(column).like(pattern))


def filter_ids(view: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the structures named in ``ids``; never duplicates a row."""
    return view.join(ids.select("id"), "id", "left_semi")


def expand_range(df: DataFrame, count: str, name: str, keys: list[str]) -> DataFrame:
    """Repeat each row ``count`` times numbered from 0, spreading large counts.

    Chunks are laid out first and shuffled, so one row with a huge count is generated
    by many tasks.
    """
    chunk = F.lit(ENTRIES_PER_TASK).cast("long")
    last = F.floor((F.col(count) - 1) / chunk)
    chunks = df.where(F.col(count) > 0).withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    spread = chunks.repartition(*keys, "__chunk")
    first = F.col("__chunk") * chunk
    upto = F.least(first + chunk, F.col(count)) - 1
    return spread.withColumn(name, F.explode(F.sequence(first, upto))).drop("__chunk")


def generate_ops(ids: DataFrame, kind: str, size: int, n_sites: int, value: str = "v", site: int = 1, wall_ms: int = 0) -> DataFrame:
    """Bulk operations building one structure of ``size`` elements per id.

    ``ids`` has one column ``id``.  Elements are written by one site, the n-th with own
    clock n, the way a sequential load would.
    """
    entries = 1 if kind in ("r", "c") else size
    rows = expand_range(ids.select("id", F.lit(entries).cast("long").alias("__n")), "__n", "__i", ["id"])
    i = F.col("__i").cast("string")
    none = F.lit(None).cast("string")
    columns = {
        "r": (F.lit(""), F.lit(value)),
        "s": (i, none),
        "m": (i, F.lit(value)),
        "c": (F.lit(str(site)), F.lit("0")),
        "l": (F.concat(F.lpad(i, 12, "0"), F.lit(str(site))), F.lit(value)),
    }
    if kind not in columns:
        raise ValueError(f"unknown structure type {kind!r}")
    key, data = columns[kind]
    return rows.select(
        "id", key.alias("key"), F.lit(kind).alias("type"), data.alias("data"), F.lit(site).alias("site"),
        vc_inc(vc_zero(n_sites), site, F.col("__i") + 1).alias("lts"),
        hlc(F.lit(wall_ms), F.col("__i") + 1).alias("pts"), F.lit("a").alias("op"),
    ).select(*PAYLOAD_COLUMNS)


def generate_nested_ops(roots: DataFrame, depth: int, n_sites: int, site: int = 1, wall_ms: int = 0) -> DataFrame:
    """A chain of one-entry maps below each root: ``m-<root>-1`` .. ``m-<root>-<depth>``.

    Every map holds key ``k-1`` pointing at the next map.
    """
    levels = roots.select("root", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("__j"))
    def name(j):
        return F.concat(F.lit("m-"), F.col("root").cast("string"), F.lit("-"), j.cast("string"))
    return levels.select(
        name(F.col("__j")).alias("id"), F.lit("k-1").alias("key"), F.lit("m").alias("type"),
        name(F.col("__j") + 1).alias("data"), F.lit(site).alias("site"),
        vc_inc(vc_zero(n_sites), site).alias("lts"), hlc(F.lit(wall_ms), F.lit(1)).alias("pts"),
        F.lit("a").alias("op"),
    ).select(*PAYLOAD_COLUMNS)
