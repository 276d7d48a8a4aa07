"""The materialised present as a plain Parquet table that is only ever appended to.

Every batch adds the frontier of its own operations; reading resolves all rows together.
A row's identity is the row itself, so a batch that comes again, late, in part or from
another stream merges like any other, and no batch needs to see the table.  The table
grows with the batches until a compaction, an ordinary Spark job, writes what is present
to a new table.
"""

from pyspark.sql import DataFrame, SparkSession

from causalog.operators.merge import as_merged
from causalog.operators.present import causal_present
from causalog.schema import PRESENT, PRESENT_COLUMNS


class PresentTable:
    """The table in the folder ``path``, which is made if it is not there."""

    def __init__(self, spark: SparkSession, path: str, n_sites: int, mode: str = "exact"):
        self.spark, self.path, self.n_sites, self.mode = spark, path, n_sites, mode
        self.append(spark.createDataFrame([], PRESENT))

    def _resolved(self, rows: DataFrame) -> DataFrame:
        return causal_present(rows.select(*PRESENT_COLUMNS), self.n_sites, mode=self.mode)

    def rows(self) -> DataFrame:
        """All appended rows, superseded ones too."""
        return self.spark.read.schema(PRESENT).parquet(self.path)

    def read(self) -> DataFrame:
        """The present.  A filter on ``id`` reaches the scan."""
        return self._resolved(self.rows())

    def append(self, rows: DataFrame) -> None:
        """Add rows that are resolved already."""
        rows.select(*PRESENT_COLUMNS).sortWithinPartitions("id", "key").write.mode("append").parquet(self.path)

    def merge(self, batch: DataFrame) -> None:
        """Merge one batch of operations; merging it again changes nothing."""
        self.append(self._resolved(as_merged(batch)))

    def compacted(self, path: str) -> "PresentTable":
        """A new table of what is present, in ranges of (id, key), so that id filters skip files.

        This table stays as it is.  Streams that go on appending to it lose nothing: what
        they added meanwhile merges when ``rows()`` is appended to the new table once more.
        """
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = PresentTable(self.spark, path, self.n_sites, self.mode)
        table.append(self.read().repartitionByRange(parts, "id", "key"))
        return table


def write_present(rows: DataFrame, path: str, n_sites: int) -> PresentTable:
    """Store already resolved rows as a table."""
    table = PresentTable(rows.sparkSession, path, n_sites)
    table.append(rows)
    return table


def merge_stream(ops: DataFrame, table: PresentTable, checkpoint: str, available_now: bool = False):
    """Merge a stream of operations continuously; one micro-batch is one append.

    Late operations merge like any others, so there is no watermark.  A batch replayed
    after a failure, or read again by a second stream, changes nothing.
    """
    writer = ops.writeStream.foreachBatch(lambda batch, number: table.merge(batch))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def reject_stream(rejects: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Append the rejected rows of a stream to a folder of Parquet files."""
    writer = rejects.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
