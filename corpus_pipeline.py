"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and, but for
the last, returns the columns it got.  ``run`` writes each stage's rows as Parquet to
the shared folder and reads them again.  Every stage decides on every row by itself,
known by a key of its own where an operator is joined back.
"""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalog.llm import quality
from causalog.llm.common import fresh, shared_folder, sized_broadcast, stable, table, written
from causalog.llm.decontaminate import decontaminate
from causalog.llm.mixing import mix
from causalog.llm.sharding import hilbert_shards
from causalog.llm.simhash import near_duplicates

#: Rejected from here down: the linear model takes the text for bad.
LEAST_QUALITY = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality model does not reject.

    Texts of fewer than ``quality.LEAST_WORDS`` words cast no votes, but are scored and may
    be rejected like others; null, empty and wordless texts get the score of the bias.
    """
    score = fresh(docs, "_quality")
    scored = quality.with_quality(docs, quality.train(docs), score_col=score)
    return scored.where(F.col(score) >= LEAST_QUALITY).drop(score)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a unique number per row, written once so that it stays, and that column's name."""
    key = fresh(docs, "_row")
    return written(docs.withColumn(key, F.monotonically_increasing_id())), key


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates: the smallest id, null last, and of its rows any one.

    Rows that repeat an id, null ids too, are each compared by their own text.
    """
    rows, key = keyed(docs)
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col(key).alias("row"))
    found = near_duplicates(rows.select(place.alias("place"), "text"), id_col="place")
    first = stable(found.where("place.row = component_id.row").select(F.col("place.row").alias(key)))
    return rows.join(sized_broadcast(first), key, "left_semi").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window.

    Rows that repeat an id, null ids too, are each judged by their own text.
    """
    rows, key = keyed(docs)
    found = decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=key)
    hit = stable(found.where("contaminated").select(key))
    return rows.join(sized_broadcast(hit), key, "left_anti").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, to the nearest whole number of times.

    Rows that repeat an id, null ids too, have their own takings; only rows equal in id,
    source and text share theirs.  Documents without words are not taken.  Rows are known
    by a digest of those columns, so that no text is written for it.
    """
    key, times = fresh(docs, "_key"), fresh(docs, "_times")
    content = [F.col("doc_id"), F.col("source"), F.col("text")]
    rows = docs.withColumn(key, F.struct(*[F.xxhash64(*content, F.lit(seed)).alias(f"h{seed}") for seed in (1, 2)]))
    taken = mix(rows, keep=(key,)).groupBy(key).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).where("size > 0")
    counted = stable(taken.select(key, F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias(times)).where(F.col(times) > 0))
    copies = rows.join(sized_broadcast(counted), key)
    return copies.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def hilbert_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it, in Hilbert order of size, language and source."""
    size, text = fresh(docs, "_size"), F.coalesce("text", F.lit(""))
    shaped = docs.withColumn(size, F.octet_length(text))
    return hilbert_shards(shaped, [size, "lang", "source"], 8, ties=[F.crc32(text), F.col("doc_id")], payload=docs.columns)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("hilbert_sharding", hilbert_sharding),
]

#: The model and the fingerprints are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
