"""Readers for workload logs, result files and packet captures."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causalog.session import stable

# The fields of a run log line, and the text form of one captured packet.
RUN_LOG_FIELDS = (
    "time string, message string, worker int, workers int, operation string, type string, rt double, "
    "real_time string, totalCounters int, connId int, delay bigint, count bigint"
)
PACKET_PATTERN = r"(\d+\.\d+) IP (\d+\.\d+\.\d+\.\d+)\.\d+ > (\d+\.\d+\.\d+\.\d+)\.\d+: \w+ (\d+)"


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(line, value): the lines of all files numbered from 1 in file order.

    Within one file block Spark's row ids are consecutive, so a line number is the
    count of the blocks before plus the place in the block.  Only one small row per
    block is ordered globally.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"),
        F.monotonically_increasing_id().alias("__id"),
    )
    raw = stable(raw)  # one scan: rows and blocks are numbered alike whatever the cluster does between
    blocks = raw.groupBy("__f", "__b").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = Window.orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("__f", "__b", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    line = F.col("__start") + F.col("__id") - F.col("__first") + 1
    return raw.join(starts, ["__f", "__b"]).select(line.alias("line"), "value")


def parse_run_log(lines: DataFrame) -> DataFrame:
    """Lines (line, value) to typed columns; lines that are no JSON object are skipped.

    Fields starting with an underscore are counters and go into one map; a counter that
    is no whole number is left out.  A field of another type than expected is NULL.  Each
    line is parsed once: the fields and the counters come from the same map.
    """
    everything = F.from_json("value", "map<string,string>")
    # Through a generator, as a filter on the map would be pushed down and parse again.
    parsed = lines.select("line", F.explode(F.array_compact(F.array(everything))).alias("__m"))
    names = [f.split() for f in RUN_LOG_FIELDS.split(", ")]
    counters = F.transform_values(
        F.map_filter("__m", lambda k, v: k.startswith("_") & v.try_cast("long").isNotNull()), lambda k, v: v.try_cast("long")
    )
    return parsed.select(
        "line", *[F.try_element_at("__m", F.lit(n)).try_cast(kind).alias(n) for n, kind in names], counters.alias("counters")
    )


def read_run_log(spark: SparkSession, path) -> DataFrame:
    return parse_run_log(numbered_lines(spark, path))


def read_results(spark: SparkSession, paths: list[str], numeric: tuple[str, ...] = (), dropna: bool = False) -> DataFrame:
    """CSV results of many runs, matched by column name, with the source's file stem.

    Columns in ``numeric`` are read as doubles; text that is no number becomes NULL.
    """
    out = None
    for path in paths:
        df = spark.read.option("header", True).csv(path)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    out = out.withColumns({**{c: F.col(c).try_cast("double") for c in numeric}, "_file": stem})
    return out.na.drop() if dropna else out


def parse_packets(lines: DataFrame, column: str = "value") -> DataFrame:
    """Captured lines to (time, src, dst, length); other lines are skipped."""
    def part(i: int) -> Column:
        return F.regexp_extract(column, PACKET_PATTERN, i)

    return lines.where(F.col(column).rlike(PACKET_PATTERN)).select(
        part(1).cast("double").alias("time"), part(2).alias("src"), part(3).alias("dst"), part(4).cast("long").alias("length")
    )


def read_packets(spark: SparkSession, path) -> DataFrame:
    return parse_packets(spark.read.text(path))
