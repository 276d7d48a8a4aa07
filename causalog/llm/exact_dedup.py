"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary finds the digests that may be very frequent.  Their winners are
aggregated exactly (map-side combined), and being at most ``counters`` rows they are
broadcast: rows of hot digests are settled where they lie, without a shuffle.  All
other digests go through an ordinary shuffle, where no group holds more than
2 / (counters + 1) of the rows.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalog.llm.common import column, stable

WHITE = r"[\x20\x09-\x0D]"


def misra_gries(counters: int):
    """mapInPandas function: a (digest, at_least) summary of one partition.

    Whole batches are added at once; when more than ``counters`` digests are held, the
    (counters + 1)-th largest count is taken off all, as in the merge of two summaries.
    A digest's count is too low by at most rows / (counters + 1).
    """

    def summary(batches):
        held = pd.Series(dtype="int64")
        for batch in batches:
            held = held.add(batch["digest"].value_counts(), fill_value=0).astype("int64")
            if len(held) > counters:
                held = held - held.nlargest(counters + 1).iloc[-1]
                held = held[held > 0]
        if len(held):
            yield pd.DataFrame({"digest": held.index, "at_least": held.to_numpy("int64")})

    return summary


def heavy_digests(rows: DataFrame, counters: int = 1024) -> DataFrame:
    """Candidates for hot digests, at most ``counters`` rows.

    The summaries' counts add up to at most the row count N, so at most ``counters``
    digests can have a sum over N / (counters + 1); every digest with more than
    2 N / (counters + 1) rows is among them.
    """
    total = rows.count()
    return (
        rows.select("digest")
        .mapInPandas(misra_gries(counters), "digest binary, at_least long")
        .groupBy("digest").agg(F.sum("at_least").alias("at_least"))
        .where((F.col("at_least") > total / (counters + 1)) & (F.col("at_least") > 1))
        .select("digest")
    )


def _winners(rows: DataFrame) -> DataFrame:
    """Per digest its size and the row that stays."""
    first = F.struct((-F.col("n_chars")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"), F.col("row").alias("d"))
    best = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(first).alias("best"))
    return best.select("digest", "group_size", F.col("best.c").alias("keep_id"), F.col("best.d").alias("keep_row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as empty.
    Of equal texts the row with the most code points in the original text stays, then
    the smallest id (null last), then any one of fully equal rows: exactly one row of
    a group has ``kept``.  An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(column(docs, text_col), F.lit(""))
    rows = stable(docs.select(
        column(docs, id_col).alias("id"),
        F.unhex(F.sha2(F.regexp_replace(text, WHITE + "+", ""), 256)).alias("digest"),
        F.char_length(text).alias("n_chars"),
        F.monotonically_increasing_id().alias("row"),
    ))
    heavy = stable(heavy_digests(rows, counters))  # at most ``counters`` rows, as are the winners
    hot = F.broadcast(_winners(rows.join(F.broadcast(heavy), "digest", "left_semi")))
    light = rows.join(F.broadcast(heavy), "digest", "left_anti")
    settled = rows.join(hot, "digest").unionByName(light.join(_winners(light), "digest"))
    return settled.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
