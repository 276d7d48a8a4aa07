"""Helpers shared by the document operators."""

from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causalog.session import ensure_checkpoint_dir, stable

__all__ = ["CHUNK_BYTES", "WORD", "bounded_broadcast", "bounded_sample", "chunks", "column", "fresh", "letters_lower", "lists", "shared_folder", "sized_broadcast", "stable", "table", "text_bytes", "written"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts are handed to numpy in pieces of about this many bytes, so that temporary
#: arrays stay small however many rows an Arrow batch holds.
CHUNK_BYTES = 1 << 19

#: Rows up to which the small side of a join is sent to every executor.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str) -> Column:
    """A top-level column by its exact name, dots included."""
    return df["`" + name.replace("`", "``") + "`"]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; else as it is.

    ``df`` should be cheap to count (a checkpoint or a small aggregate).  Without the
    hint the join shuffles, and adaptive execution splits hot keys.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Bytes up to which ``bounded_broadcast`` sends a side to every executor.
BROADCAST_BYTES = 64 << 20


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its values take at most ``limit`` bytes; else as it is.

    Measured over all rows: texts by their length, other columns 16 bytes each.  ``df``
    should be flat and cheap to read twice.  Without the hint the join shuffles, and
    adaptive execution splits hot keys.
    """
    texts = [F.coalesce(F.octet_length(column(df, c)), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    row = sum(texts, F.lit(16 * len(df.columns))).cast("long")
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= limit else df


def bounded_sample(rows: DataFrame, n: int, share: Column | float, keys: list[str], seed: int) -> DataFrame:
    """At most ``n`` different rows, each drawn with probability ``share`` by a hash of ``keys``.

    Rows equal in all ``keys`` are drawn once, as the smallest of them, so a group of copies
    with an id in common cannot fill the sample.  Of more than ``n`` drawn the smallest hashes
    stay: only n + 1 numbers reach the driver.  The choice depends on the rows' content alone;
    with ``keys`` from one side of a join it is made before that join's shuffle.
    """
    mark = fresh(rows, "_mark")
    found = rows.withColumn(mark, F.xxhash64(*[column(rows, k) for k in keys], F.lit(seed)))
    drawn = found.where(F.pmod(mark, F.lit(1 << 30)) / (1 << 30) < share)
    marks = sorted(r[0] for r in drawn.select(mark).distinct().orderBy(mark).limit(n + 1).collect())
    if len(marks) > n:
        drawn = drawn.where(F.col(mark) < marks[n])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = drawn.groupBy(mark).agg(F.min(F.struct(*[column(rows, c) for c in rows.columns])).alias("row"))
    return least.repartition(parts).select("row.*")


def letters_lower(text: Column) -> Column:
    """Lower-case A-Z only.  An all-ASCII text may use the faster built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch and the n + 1 offsets of the texts; null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width, len(texts) + 1, texts.offset * np.dtype(width).itemsize)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column of numpy rows."""
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of about ``limit`` bytes each; a longer text is a range by itself."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder; for rows that carry texts, as it is compressed."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()
