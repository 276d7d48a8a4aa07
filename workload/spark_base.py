"""Shared pieces of the registered queries."""

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causalog.operators.present import causal_present
from causalog.schema import OP
from causalog.session import ensure_checkpoint_dir
from causalog.sources.recipes import N_SITES, WINDOW, event_ops


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: set[str] = set()


def log(spark: SparkSession, sf_dir: str, kind: str, window: int = WINDOW) -> DataFrame:
    """One structure type's log, derived from the events once per session and stored
    as parquet in the shared checkpoint folder, as an operation log would be."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    source = os.path.abspath(sf_dir).strip("/").replace("/", "_")
    path = f"{sc.getCheckpointDir()}/logs-{sc.applicationId}/{source}-{kind}-{window}"
    if path not in _WRITTEN:
        ops = event_ops(table(spark, sf_dir, "events"), kind, window)
        ops.write.mode("overwrite").parquet(path)
        _WRITTEN.add(path)
    return spark.read.schema(OP).parquet(path)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def current(spark: SparkSession, sf_dir: str, kind: str, window: int = WINDOW, mode: str = "causal") -> DataFrame:
    """Present of one structure type, in the materialised layout."""
    rows = causal_present(log(spark, sf_dir, kind, window), N_SITES, mode=mode)
    return rows.withColumn("merged_at", F.col("arrival_time")).drop("seq", "hops", "arrival_time")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so both engines return scalars."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    options = {"ignoreNullFields": "false"}
    return df.withColumns({c: F.to_json(F.col(c), options) for c in nested}) if nested else df
