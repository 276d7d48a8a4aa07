"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is cut into blocks of equal token count.  Blocks go to sources by highest
quotients target / (2 k - 1), then a source's blocks go to its shards the same way.
A shard lays its documents out in seeded order as a ring of tokens and takes its quota
of consecutive blocks from a seeded start, so whole passes come before repeats and no
document is taken more often than ``max_epochs`` times.

Only sums per source and per shard are gathered; every row is settled by arithmetic on
its place in the ring.  DataFrame operations only.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalog.llm.common import WORD, column, sized_broadcast, stable


def source_targets(sources: DataFrame, weights: list[float], share: float, max_epochs: int) -> DataFrame:
    """Add idx, weight, cap and target to (source, source_size, ...), one row per source.

    Weights repeat over the sources by code point, null last.  Filling up by weight with
    caps: in order of cap / weight, a source is capped when its cap is at most its share
    of what the capped ones before it leave.  One window over the sources, no rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    s = (
        sources.withColumn("idx", F.row_number().over(by_name) - 1).withColumn("weight", w)
        .withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = (
        s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(later))
        .withColumn("level", F.col("left") / F.col("rest"))
        .withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    )
    open_level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("idx"), F.col("level").alias("level")))).over(every)
    return s.withColumn("open", open_level).select(
        *sources.columns, "idx", "weight", "cap",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("open.level"))).alias("target"),
    )


def sainte_lague(parties: DataFrame, within: list[str], key: str, votes: str, seats: Column, most: Column) -> DataFrame:
    """Seats per party: (within, key, quota), the ``seats`` highest quotients votes / (2 k - 1).

    With S parties and n seats a party's seats lie within q (1 +- S / 2n) +- 1/2 of its
    exact share q, so only the few quotients in that bracket are listed and ranked:
    about 4 S rows, however many seats there are.  ``most`` bounds a party's seats.
    Equal quotients go to the lower key.
    """
    group = Window.partitionBy(*within)
    c = F.col
    s = (
        parties.where(c(votes) > 0)
        .select(*within, key, c(votes).cast("double").alias("_votes"), seats.cast("double").alias("_seats"), most.cast("long").alias("_most"))
        .where("_seats > 0")
        .withColumn("_share", c("_seats") * c("_votes") / F.sum("_votes").over(group))
        .withColumn("_slack", c("_share") * F.count(F.lit(1)).over(group) / c("_seats") + 2)
        .withColumn("_base", F.least("_most", F.greatest(F.lit(0), F.floor(c("_share") - c("_slack")))).cast("long"))
        .withColumn("_top", F.least("_most", F.ceil(c("_share") + c("_slack"))).cast("long"))
        .withColumn("_free", c("_seats") - F.sum("_base").over(group))
    )
    # Seat number _base stands for the seats that are certain; it has no quotient.
    tries = s.withColumn("_seat", F.explode(F.sequence(c("_base"), c("_top")))).withColumn(
        "_quotient", F.when(c("_seat") > c("_base"), c("_votes") / (2 * c("_seat") - 1)))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(c("_quotient").desc_nulls_last(), key, "_seat"))
    won = c("_quotient").isNotNull() & (rank <= c("_free"))
    return (
        tries.withColumn("_won", won.cast("long"))
        .groupBy(*within, key).agg((F.first("_base") + F.sum("_won")).alias("quota"))
    )


def _number(text: Column, digits: int = 8) -> Column:
    """A non-negative number from the leading hex digits of an md5."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _overlap(a: Column, length: Column, x: Column, size: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a + length, x + size) - F.greatest(a, x))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: list[float] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2,
    block: int = 16, shard_rows: int = 2048, seed: int = 7, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, shard, taken, and the columns of ``keep``.

    ``size`` counts words; null and empty texts have 0 and take 0.  A null source is a
    source of its own, last.  The order of documents depends on seed, id and size alone,
    so reruns agree and repeated rows get the same multiset of takings.  An empty table
    or one without words gives targets of 0 and takes nothing.  ``shard_rows`` is about
    how many rows one window holds.
    """
    rows = stable(docs.select(
        column(docs, id_col).alias("id"), column(docs, source_col).alias("source"),
        F.coalesce(F.regexp_count(column(docs, text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *[column(docs, c).alias(f"_keep{i}") for i, c in enumerate(keep)],
    ))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = stable(source_targets(sources, list(weights), share, max_epochs))
    n = F.floor(F.sum("target").over(Window.partitionBy()) / block + 0.5)
    blocks_most = F.ceil(F.col("cap") / block)
    quotas = sainte_lague(
        targets.withColumn("n", n).withColumn("all", F.lit(0)), ["all"], "idx", "target", F.col("n"), blocks_most,
    ).select("idx", "quota")
    # Null keys are gone from here on: sources are known by idx.
    known = stable(
        targets.join(quotas, "idx", "left").fillna(0, ["quota"])
        .withColumn("shards", F.ceil(F.col("rows") / shard_rows))
    )
    tag = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size").cast("string")))
    placed = (
        rows.join(
            sized_broadcast(known.select(F.col("source").alias("_s"), "idx", "source_size", "target", "shards")),
            F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s").withColumn("tag", tag)
        .withColumn("shard", F.conv(F.substring("tag", 1, 8), 16, 10).cast("long") % F.col("shards"))
    )
    shards = placed.groupBy("idx", "shard").agg(F.sum("size").alias("tokens")).join(sized_broadcast(known.select("idx", "quota")), "idx")
    won = sainte_lague(shards, ["idx"], "shard", "tokens", F.col("quota"), F.ceil(F.col("tokens") * max_epochs / block))
    # Length and start of each shard's run on its ring.
    runs = shards.drop("quota").join(won, ["idx", "shard"], "left").select(
        "idx", "shard", "tokens",
        F.least(F.coalesce(F.col("quota"), F.lit(0)) * block, F.col("tokens") * max_epochs).alias("length"),
        F.when(F.col("tokens") > 0, _number(F.concat_ws(":", F.lit(f"run{seed}"), "idx", "shard")) % F.ceil(F.col("tokens") / block) * block)
        .otherwise(F.lit(0)).alias("start"),
    )
    ring = Window.partitionBy("idx", "shard").orderBy("tag", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("x")
    taken = sum((_overlap(F.col("start"), F.col("length"), x + k * F.col("tokens"), F.col("size")) for k in range(max_epochs + 1)), F.lit(0))
    return (
        placed.withColumn("x", F.sum("size").over(ring) - F.col("size"))
        .join(runs, ["idx", "shard"])
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "shard", taken.cast("long").alias("taken"),
                *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)])
    )
