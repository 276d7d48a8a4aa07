"""Session settings the operators rely on."""

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Skew-join splitting and partition coalescing carry the equi-joins of this library
# over hot keys; the event-time columns are wall-clock UTC.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Checkpoint files go when no DataFrame can read them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def builder(app_name: str = "causalog") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app_name)
    for key, value in RECOMMENDED.items():
        b = b.config(key, value)
    return b


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``checkpoint()`` at the cluster's shared folder.

    The folder comes from ``spark.checkpoint.dir``.  Only a local-mode session that
    names none gets a scratch folder; a cluster without one is an error, because an
    executor's own disk would not outlive the executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="causalog-checkpoint-")
    sc.setCheckpointDir(configured)


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    Used where one result feeds several branches that must see identical rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
