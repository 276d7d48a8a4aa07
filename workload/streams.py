"""Streaming queries: the log as files, read by a stream until it is used up."""

import uuid

from pyspark.sql import functions as F

from causalog.sources.ops import append_ops, read_ops_stream
from causalog.sources.recipes import N_SITES
from causalog.streaming.frontier import COLUMNS, present_stateful
from causalog.streaming.store import PresentTable, merge_stream, write_present
from workload.spark_base import current, flat, log
from workload.sql_parts import with_log, with_present
from workload.views import _halves

SPARK, SQL = {}, {}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def query(name, sql=None):
    def register(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def _folder(spark):
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _log_files(spark, sf_dir, folder, files=6):
    """The log in files of random rows, so late operations arrive in later batches."""
    append_ops(log(spark, sf_dir, "m").repartition(files, F.xxhash64("seq")), f"{folder}/log")
    return read_ops_stream(spark, f"{folder}/log", N_SITES, max_files=2)[0]


_ROWS = "SELECT id, key, site, CAST(to_json(lts) AS VARCHAR) AS lts, op, data, pt AS merged_at FROM cur"


def _rows(df):
    return flat(df.select("id", "key", "site", "lts", "op", "data", "merged_at"))


@query("merge_stream", with_present("m", _ROWS))
def merge_stream_query(spark, sf_dir):
    log(spark, sf_dir, "m")
    folder = _folder(spark)
    store = PresentTable(spark, f"{folder}/present", N_SITES, mode="causal")
    merge_stream(_log_files(spark, sf_dir, folder), store, f"{folder}/checkpoint", available_now=True).awaitTermination()
    return _rows(store.read())


@query("compacted_present", with_present("m", _ROWS))
def compacted_present_query(spark, sf_dir):
    """Batches merged in any order and again, two tables' rows together, then compacted."""
    ops = log(spark, sf_dir, "m")
    folder = _folder(spark)
    tables = [PresentTable(spark, f"{folder}/{name}", N_SITES, mode="causal") for name in ("a", "b")]
    for part in (2, 0, 1, 2):
        tables[part % 2].merge(ops.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == part))
    compacted = tables[0].compacted(f"{folder}/c")
    compacted.append(tables[1].rows())
    return _rows(compacted.compacted(f"{folder}/d").rows())


def _changes(spark, folder, ops, present=None):
    """Every change a stateful stream over ``ops`` emits until the log is used up."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    try:
        changes = present_stateful(ops, causal=True, present=present)
        sink = changes.writeStream.outputMode("update").foreachBatch(
            lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/changes")
        )
        sink.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{folder}/changes")


def _net(changes):
    return _rows(changes.groupBy("id", "key", *COLUMNS).agg(
        F.sum(F.when(F.col("change") == "in", 1).otherwise(-1)).alias("net")).where("net > 0"))


@query("present_stateful", with_present("m", _ROWS))
def present_stateful_query(spark, sf_dir):
    """The changes a stream emitted, summed up to what is present at its end."""
    log(spark, sf_dir, "m")
    folder = _folder(spark)
    return _net(_changes(spark, folder, _log_files(spark, sf_dir, folder)))


@query("present_resumed", with_present("m", _ROWS))
def present_resumed_query(spark, sf_dir):
    """A stream over the later half of the log that starts from the present of the earlier half."""
    local, late = _halves(spark, sf_dir, "m")
    folder = _folder(spark)
    append_ops(late.repartition(4, F.xxhash64("seq")), f"{folder}/log")
    local = write_present(local, f"{folder}/present", N_SITES).rows()
    changes = _changes(spark, folder, read_ops_stream(spark, f"{folder}/log", N_SITES, max_files=2)[0], local)
    start = local.select("id", "key", F.lit("in").alias("change"), "type", "data", "site", "lts", "pts.physical_time", "pts.logical_time", "op", "merged_at")
    return _net(changes.drop("batch").unionByName(start))


@query("append_ops", with_log("m", "SELECT id, key, site, seq, CAST(0 AS INTEGER) AS hops, pt AS arrival_time FROM ops"))
def append_ops_query(spark, sf_dir):
    ops = log(spark, sf_dir, "m").drop("hops", "arrival_time")
    folder = _folder(spark)
    append_ops(ops, f"{folder}/log")
    return spark.read.parquet(f"{folder}/log").select("id", "key", "site", "seq", "hops", "arrival_time")


@query("write_present", with_present("m", _ROWS))
def write_present_query(spark, sf_dir):
    rows = current(spark, sf_dir, "m")
    return _rows(write_present(rows, f"{_folder(spark)}/present", N_SITES).read())
