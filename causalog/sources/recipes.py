"""Operation logs derived from the sample tables.

The same rules are written once more as SQL text for the cross-check, so both engines
see one log.  Sites exchange everything at each boundary of ``window`` events and are
concurrent inside a window, which makes the logs causally consistent.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalog.functions.clocks import hlc
from causalog.plans.scan import Running, prefix_scan
from causalog.schema import OP_COLUMNS

N_SITES = 3
WINDOW = 2048
EPOCHS_PER_BUCKET = 4096


def structure_id(kind: str) -> Column:
    """A structure per user, so structures grow with the input; every fifth user writes to one hot structure."""
    owner = F.when(F.col("user_id") % 5 == 0, F.lit(0).cast("long")).otherwise(F.col("user_id"))
    return F.concat(F.lit(kind + "-"), owner.cast("string"))


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.expr(
        f"cast(unix_date(cast({ts} as date)) as bigint) * 86400000 + hour({ts}) * 3600000L"
        f" + minute({ts}) * 60000L + cast(floor(extract(second from {ts}) * 1000) as bigint)"
    )


def _stamped_events(events: DataFrame, kind: str, window: int) -> DataFrame:
    """Events with site, structure id, and per-site counts seen at the last exchange."""
    base = events.select(
        "event_id",
        (F.lit(1) + F.col("event_id") % N_SITES).cast("int").alias("site"),
        F.floor(F.col("event_id") / window).alias("epoch"),
        structure_id(kind).alias("id"),
        epoch_ms("ts").alias("pt"),
        (F.col("event_id") % 4).cast("int").alias("lt"),
        F.floor(F.col("value") * 100).cast("long").alias("v"),
        "event_type",
        "value",
    )
    at = {s: F.col("site") == s for s in range(1, N_SITES + 1)}
    totals = base.groupBy("id", "epoch").agg(
        *[F.count(F.when(at[s], 1)).alias(f"n{s}") for s in at],
        *[F.sum(F.when(at[s], F.col("v"))).alias(f"v{s}") for s in at],
    )
    before = prefix_scan(
        totals, ["id"], ["epoch"], F.floor(F.col("epoch") / EPOCHS_PER_BUCKET),
        {name: Running("sum", F.col(name[1:]), inclusive=False) for name in [f"b{c}{s}" for c in "nv" for s in at]},
    ).select("id", "epoch", *[f"b{c}{s}" for c in "nv" for s in at])
    joined = base.join(before, ["id", "epoch"])
    here = Window.partitionBy("id", "epoch", "site").orderBy("event_id")
    running = here.rowsBetween(Window.unboundedPreceding, 0)

    def own(prefix: str) -> Column:
        return F.coalesce(*[F.when(at[s], F.col(f"{prefix}{s}")) for s in at], F.lit(0))

    joined = joined.withColumns({
        "own": own("bn") + F.row_number().over(here),
        "subtotal": own("bv") + F.sum("v").over(running),
    })
    lts = F.array(*[
        F.when(at[s], F.col("own")).otherwise(F.coalesce(F.col(f"bn{s}"), F.lit(0))).cast("long") for s in at
    ])
    return joined.withColumn("lts", lts)


def event_ops(events: DataFrame, kind: str, window: int = WINDOW) -> DataFrame:
    """The log of one structure type: r, s, m, c or l."""
    ev = _stamped_events(events, kind, window)
    removed = (F.col("event_type") == "error") | (F.col("value") < 20)
    text_v = F.col("v").cast("string")
    none = F.lit(None).cast("string")
    if kind in ("m", "s"):
        key, op = F.col("event_type"), F.when(removed, "r").otherwise("a")
        data = F.when(~removed, text_v) if kind == "m" else none
    elif kind == "r":
        key, op, data = F.lit(""), F.lit("a"), text_v
    elif kind == "c":
        key, op, data = F.col("site").cast("string"), F.lit("a"), F.col("subtotal").cast("string")
    elif kind == "l":
        error = F.col("event_type") == "error"
        ev = ev.withColumn("slot", F.concat(F.lpad(F.col("event_id").cast("string"), 12, "0"), F.col("site")))
        ev = prefix_scan(
            ev, ["id", "site"], ["event_id"], F.col("epoch"),
            {"prev": Running("last", F.when(~error, F.col("slot")), inclusive=False)},
        )
        key = F.when(error, F.coalesce("prev", "slot")).otherwise(F.col("slot"))
        op, data = F.when(error, "r").otherwise("a"), F.when(~error, text_v)
    else:
        raise ValueError(f"unknown structure type {kind!r}")
    return ev.select(
        "id", key.alias("key"), F.lit(kind).alias("type"), data.alias("data"), "site", "lts",
        hlc(F.col("pt"), F.col("lt")).alias("pts"), op.alias("op"),
        F.col("event_id").alias("seq"), F.lit(0).alias("hops"), F.col("pt").alias("arrival_time"),
    ).select(*OP_COLUMNS)


def cart_ops(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Typed cart operations: one per order line."""
    lines = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    heads = orders.select("o_orderkey", "o_custkey", epoch_ms("o_orderdate").alias("pt"))
    joined = lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
    site = (F.lit(1) + F.col("l_linenumber") % N_SITES).cast("int")
    return joined.select(
        F.col("o_custkey").alias("cart_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.when(F.col("l_returnflag") == "R", "r").otherwise("a").alias("op"),
        site.alias("site"),
        F.array(F.col("l_orderkey"), F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long")).alias("lts"),
        hlc(F.col("pt"), F.col("l_linenumber")).alias("pts"),
    )
