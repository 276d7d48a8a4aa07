"""Conflict rules: what a set of concurrent operations means to a reader.

Every function takes the readable rows (see ``present``).  Winners are picked with
``min_by`` over a sort struct, so rows combine before the shuffle and a filter on
``id`` or ``key`` still reaches the scan.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalog.functions.ordering import asc, newest_first
from causalog.plans.scan import row_numbers, sorted_buckets


def _typed(present: DataFrame, kind: str) -> DataFrame:
    return present.where(F.col("type") == kind)


def _newest(*extra: Column) -> Column:
    """Newest first, then lowest site, then the given columns, then the clock."""
    return F.struct(newest_first(F.col("pts")), asc(F.col("site")), *extra, asc(F.col("lts")))


def _values_by_site() -> Column:
    """All values ordered by site.  Structs keep NULL values in the list."""
    pairs = F.collect_list(F.struct(asc(F.col("site")).alias("s"), asc(F.col("data")).alias("d"), F.col("data").alias("data")))
    return F.transform(F.array_sort(pairs), lambda x: x["data"])


def _collect(rows: DataFrame) -> DataFrame:
    """One row per structure holding its sorted elements."""
    return rows.groupBy("id").agg(F.array_sort(F.collect_list("data")).alias("data"))


# registers


def register_mvr(present: DataFrame) -> DataFrame:
    """All concurrent values of each register, ordered by site."""
    return _typed(present, "r").groupBy("id").agg(_values_by_site().alias("data"))


def register_lww(present: DataFrame) -> DataFrame:
    """Newest value of each register."""
    win = F.min_by(F.struct("data"), _newest(asc(F.col("data"))))
    return _typed(present, "r").groupBy("id").agg(win.alias("__w")).select("id", F.col("__w.data").alias("data"))


# sets


def set_aw(present: DataFrame) -> DataFrame:
    """An element is in the set if any surviving operation added it."""
    return _typed(present, "s").where("op = 'a'").select("id", F.col("key").alias("data")).distinct()


def set_rw(present: DataFrame) -> DataFrame:
    """An element is in the set only if no surviving operation removed it."""
    rows = _typed(present, "s").groupBy("id", "key").agg(
        F.max(F.col("op") == "a").alias("added"), F.max(F.col("op") == "r").alias("removed")
    )
    return rows.where("added and not removed").select("id", F.col("key").alias("data"))


def set_lww(present: DataFrame) -> DataFrame:
    """The newest operation on an element decides."""
    rows = _typed(present, "s").groupBy("id", "key").agg(F.min_by(F.struct("op"), _newest()).alias("__w"))
    return rows.where(F.col("__w.op") != "r").select("id", F.col("key").alias("data"))


def set_aw_tuple(present: DataFrame) -> DataFrame:
    return _collect(set_aw(present))


def set_rw_tuple(present: DataFrame) -> DataFrame:
    return _collect(set_rw(present))


def set_lww_tuple(present: DataFrame) -> DataFrame:
    return _collect(set_lww(present))


# maps


def _entry(value: Column) -> Column:
    return F.struct(F.col("key").alias("key"), value.alias("value")).alias("data")


def map_aw_mvr(present: DataFrame) -> DataFrame:
    """Every concurrently added value of each key."""
    rows = _typed(present, "m").where("op = 'a'").groupBy("id", "key").agg(_values_by_site().alias("__v"))
    return rows.select("id", _entry(F.col("__v")))


def map_aw_lww(present: DataFrame) -> DataFrame:
    """The newest add of each key; removes lose against concurrent adds."""
    rows = _typed(present, "m").where("op = 'a'").groupBy("id", "key").agg(
        F.min_by(F.struct("data"), _newest(asc(F.col("data")))).alias("__w")
    )
    return rows.select("id", _entry(F.col("__w.data")))


def map_rw_mvr(present: DataFrame) -> DataFrame:
    """Every concurrently added value of each key no surviving operation removed."""
    added = F.col("op") == "a"
    pairs = F.collect_list(
        F.when(added, F.struct(asc(F.col("site")).alias("s"), asc(F.col("data")).alias("d"), F.col("data").alias("data")))
    )
    rows = _typed(present, "m").groupBy("id", "key").agg(
        F.transform(F.array_sort(pairs), lambda x: x["data"]).alias("__v"),
        F.max(added).alias("added"),
        F.max(F.col("op") == "r").alias("removed"),
    )
    return rows.where("added and not removed").select("id", _entry(F.col("__v")))


def map_lww(present: DataFrame) -> DataFrame:
    """The newest operation on a key decides."""
    rows = _typed(present, "m").groupBy("id", "key").agg(
        F.min_by(F.struct("op", "data"), _newest(asc(F.col("data")))).alias("__w")
    )
    return rows.where(F.col("__w.op") != "r").select("id", _entry(F.col("__w.data")))


def map_aw_mvr_tuple(present: DataFrame) -> DataFrame:
    return _collect(map_aw_mvr(present))


def map_aw_lww_tuple(present: DataFrame) -> DataFrame:
    return _collect(map_aw_lww(present))


def map_rw_mvr_tuple(present: DataFrame) -> DataFrame:
    return _collect(map_rw_mvr(present))


def map_lww_tuple(present: DataFrame) -> DataFrame:
    return _collect(map_lww(present))


# counters


def counter(present: DataFrame) -> DataFrame:
    """Sum of every site's running subtotal."""
    total = F.sum(F.col("data").cast("decimal(38,0)")).cast("long")
    return _typed(present, "c").groupBy("id").agg(total.alias("data"))


# lists


def list_unsorted(present: DataFrame) -> DataFrame:
    return _typed(present, "l").where("op != 'r'").select("id", F.col("key").alias("pos"), "data")


def list_view(present: DataFrame) -> DataFrame:
    """List elements in reading order."""
    rows = _typed(present, "l").where("op != 'r'")
    ordered = rows.orderBy("id", "key", F.asc_nulls_last("site"), F.desc_nulls_first("pts"))
    return ordered.select("id", F.col("key").alias("pos"), "data")


def list_tuple(present: DataFrame) -> DataFrame:
    rows = _typed(present, "l").where("op != 'r'")
    entry = F.struct(
        F.col("key").alias("k"), asc(F.col("site")).alias("s"), newest_first(F.col("pts")).alias("p"),
        F.col("data").alias("data"),
    )
    return rows.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["data"]).alias("data")
    )


def pages(rows: DataFrame, order: str, page_rows: int) -> DataFrame:
    """The collection of each structure in pages: (id, page, data).

    A tuple view holds a whole structure in one row.  For structures too large for that,
    give the row form of a view here: pages hold at most ``page_rows`` elements each, in
    order, and one structure's pages are built by many tasks.
    """
    ranged = sorted_buckets(rows, ["id", order])
    numbered = row_numbers(ranged, ["id"], [order], F.col("__range"), "__n")
    page = F.floor((F.col("__n") - 1) / page_rows).alias("page")
    held = F.array_sort(F.collect_list(F.struct("__n", "data")))
    return numbered.groupBy("id", page).agg(F.transform(held, lambda x: x["data"]).alias("data"))


# any typed operation table

RULES = ("aw", "rw", "lww")


def resolve(
    df: DataFrame,
    keys: list[str],
    rule: str = "lww",
    order: Column | None = None,
    op: str = "op",
    remove: str = "r",
) -> DataFrame:
    """Apply a conflict rule to a typed operation table.

    Keeps one row per ``keys``: the first by ``order`` (newest, then lowest site, by
    default) among the rows the rule lets win.  The payload is every other column.
    """
    payload = [c for c in df.columns if c not in keys]
    order = _newest() if order is None else order
    winner = F.min_by(F.struct(*payload), order)
    if rule == "lww":
        rows = df.groupBy(*keys).agg(winner.alias("__w")).where(F.col(f"__w.{op}") != remove)
    elif rule == "aw":
        rows = df.where(F.col(op) != remove).groupBy(*keys).agg(winner.alias("__w"))
    elif rule == "rw":
        removed = F.max(F.col(op) == remove).alias("__x")
        rows = df.groupBy(*keys).agg(winner.alias("__w"), removed).where(~F.col("__x"))
    else:
        raise ValueError(f"unknown rule {rule!r}; expected one of {RULES}")
    return rows.select(*[F.col(c) if c in keys else F.col(f"__w.{c}").alias(c) for c in df.columns])


def cart_lww(ops: DataFrame) -> DataFrame:
    """Products and quantities of every cart, newest operation first."""
    order = F.struct(newest_first(F.col("pts")), asc(F.col("site")), asc(F.col("lts")))
    return resolve(ops, ["cart_id", "product_id"], "lww", order).select("cart_id", "product_id", "quantity")


def cart_products(ops: DataFrame, cart_id) -> DataFrame:
    """Contents of one cart.  The filter reaches the scan through the grouping keys."""
    return cart_lww(ops).where(F.col("cart_id") == cart_id).select("product_id", "quantity")


def carts_with_product_range(ops: DataFrame, low: int, high: int) -> DataFrame:
    """Carts holding at least one product of a range."""
    return cart_lww(ops).where(F.col("product_id").between(low, high)).select("cart_id").distinct()


VIEWS = {
    "register_mvr": register_mvr,
    "register_lww": register_lww,
    "set_aw": set_aw,
    "set_aw_tuple": set_aw_tuple,
    "set_rw": set_rw,
    "set_rw_tuple": set_rw_tuple,
    "set_lww": set_lww,
    "set_lww_tuple": set_lww_tuple,
    "map_aw_mvr": map_aw_mvr,
    "map_aw_mvr_tuple": map_aw_mvr_tuple,
    "map_aw_lww": map_aw_lww,
    "map_aw_lww_tuple": map_aw_lww_tuple,
    "map_rw_mvr": map_rw_mvr,
    "map_rw_mvr_tuple": map_rw_mvr_tuple,
    "map_lww": map_lww,
    "map_lww_tuple": map_lww_tuple,
    "counter": counter,
    "list": list_view,
    "list_unsorted": list_unsorted,
    "list_tuple": list_tuple,
}


def view(name: str, present: DataFrame) -> DataFrame:
    if name not in VIEWS:
        raise ValueError(f"unknown view {name!r}")
    return VIEWS[name](present)
