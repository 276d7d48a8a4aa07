"""Write intents to stamped operations, a whole batch at a time.

An intent is (id, verb, key, value, delta, index, site, wall_ms, intent_seq);
``intent_seq`` is non-negative and unique per site.  The result equals running the
intents one by one in that order at each site, where a site sees its own earlier
intents and no other site's (for lists see ``list_edits``).

An *effect* is the operation an intent causes, before it has a timestamp.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalog.functions.clocks import coord, hlc
from causalog.functions.positions import position_at, with_gap
from causalog.operators import resolve as R
from causalog.operators.list_edits import BLOCK, list_items
from causalog.operators.lookup import list_ranks
from causalog.plans.scan import Running, prefix_scan, row_numbers
from causalog.schema import OP_COLUMNS
from causalog.session import stable

# Consecutive sequence numbers handled by one task in the running totals.
WIDTH = 1 << 20

EFFECT_COLUMNS = ["id", "key", "type", "data", "op", "site", "wall_ms", "intent_seq"]

_PLAIN = {
    # verb: (structure type, key column, data column, operation)
    "register_set": ("r", None, "value", "a"),
    "set_add": ("s", "key", None, "a"),
    "set_rmv": ("s", "key", None, "r"),
    "map_add": ("m", "key", "value", "a"),
    "map_rmv": ("m", "key", None, "r"),
}
_COUNTER = ("counter_inc", "counter_dec")
_INSERT = ("list_insert_at", "list_append", "list_prepend")
_POP = ("list_pop_first", "list_pop_last")
_LIST = (*_INSERT, *_POP, "list_rmv")
_CLEAR = {"s": "set_clear", "m": "map_clear", "l": "list_clear"}
VERBS = (*_PLAIN, *_COUNTER, *_LIST, *_CLEAR.values())


def _bucket(order: str, width: int) -> Column:
    return F.floor(F.col(order) / width)


def _by_verb(pick) -> Column:
    out = None
    for verb, shape in _PLAIN.items():
        cond = F.col("verb") == verb
        out = F.when(cond, pick(shape)) if out is None else out.when(cond, pick(shape))
    return out


def plain_effects(intents: DataFrame) -> DataFrame:
    """Register, set and map writes: a projection."""
    none = F.lit(None).cast("string")
    return intents.where(F.col("verb").isin(*_PLAIN)).select(
        "id",
        _by_verb(lambda s: F.lit("") if s[1] is None else F.col(s[1])).alias("key"),
        _by_verb(lambda s: F.lit(s[0])).alias("type"),
        _by_verb(lambda s: none if s[2] is None else F.col(s[2])).alias("data"),
        _by_verb(lambda s: F.lit(s[3])).alias("op"),
        "site", "wall_ms", "intent_seq",
    )


def counter_effects(intents: DataFrame, present: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each increment writes the site's new subtotal."""
    moves = intents.where(F.col("verb").isin(*_COUNTER)).withColumn(
        "__d", F.when(F.col("verb") == "counter_inc", F.col("delta")).otherwise(-F.col("delta"))
    )
    moves = prefix_scan(
        moves, ["id", "site"], ["intent_seq"], _bucket("intent_seq", width), {"__run": Running("sum", F.col("__d"))}, levels=2
    )
    base = present.where("type = 'c'").groupBy("id", F.col("key").cast("int").alias("site")).agg(
        F.max_by(F.col("data").cast("long"), coord("lts", F.col("key").cast("int"))).alias("__base")
    )
    total = F.coalesce("__base", F.lit(0)) + F.col("__run")
    return moves.join(base, ["id", "site"], "left").select(
        "id", F.col("site").cast("string").alias("key"), F.lit("c").alias("type"),
        total.cast("string").alias("data"), F.lit("a").alias("op"), "site", "wall_ms", "intent_seq",
    )


def _sizes(present: DataFrame) -> DataFrame:
    return present.where("type = 'l' and op != 'r'").groupBy("id").agg(F.count("*").alias("__size"))


def _new_positions(new: DataFrame, ranks: DataFrame, mode: str, site_digits: int) -> DataFrame:
    """Positions (id, site, seq, key, by) of new elements (id, site, ord, seq, by, old).

    Gap g lies before the old element at index g; the new elements of a gap share it by
    rank, those removed again included.
    """
    gap = ["id", "site", "old"]
    counts = new.groupBy(*gap).agg(F.count("*").alias("__n"))
    rows = row_numbers(new, gap, ["ord"], _bucket("ord", WIDTH), "__rank", levels=2).join(counts, gap)
    after = ranks.select("id", F.col("index").alias("old"), F.col("pos").alias("__hi"))
    before = ranks.select("id", (F.col("index") + 1).alias("old"), F.col("pos").alias("__lo"))
    rows = rows.join(before, ["id", "old"], "left").join(after, ["id", "old"], "left")
    rows = with_gap(rows, "__lo", "__hi", "__n", "site", site_digits)
    return rows.select("id", "site", "seq", position_at("__n", "__rank", mode).alias("key"), "by")


def list_effects(intents: DataFrame, present: DataFrame, mode: str = "regular", width: int = WIDTH, site_digits: int = 1) -> DataFrame:
    """Inserts, removes and pops, each on the list as the site's earlier edits leave it.

    An index past the end appends; removing an index outside the list does nothing.
    """
    ranks = stable(list_ranks(present).select("id", "index", "pos"))
    items = stable(list_items(intents, _sizes(present), min(width, BLOCK), width))
    new = stable(_new_positions(items.where("seq is not null").drop("lo", "live"), ranks, mode, site_digits))
    old = items.where("seq is null and by >= 0").select("id", "site", F.col("lo").alias("index"), "by")
    gone = old.join(ranks, ["id", "index"]).select("id", "site", "by", F.col("pos").alias("key")).unionByName(
        new.where("by >= 0").select("id", "site", "by", "key"))
    who = ["id", "site", "intent_seq"]
    made = intents.select(*who, "wall_ms", "value")
    added = new.select("id", "site", F.col("seq").alias("intent_seq"), "key").join(made, who).select(
        "id", "key", F.lit("l").alias("type"), F.col("value").alias("data"), F.lit("a").alias("op"), "site", "wall_ms", "intent_seq")
    return added.unionByName(gone.withColumnRenamed("by", "intent_seq").join(made, who).select(
        "id", "key", F.lit("l").alias("type"), F.lit(None).cast("string").alias("data"), F.lit("r").alias("op"), "site", "wall_ms", "intent_seq"))


def list_popped(intents: DataFrame, present: DataFrame, width: int = WIDTH) -> DataFrame:
    """What each pop returns, elements of the batch itself included; NULL once the list is empty."""
    items = stable(list_items(intents, _sizes(present), min(width, BLOCK), width).where("by >= 0"))
    old = items.where("seq is null").select("id", "site", F.col("lo").alias("index"), F.col("by").alias("intent_seq"))
    values = old.join(list_ranks(present).select("id", "index", "data"), ["id", "index"]).select("id", "site", "intent_seq", "data")
    added = intents.where(F.col("verb").isin(*_INSERT)).select("id", "site", F.col("intent_seq").alias("seq"), F.col("value").alias("data"))
    values = values.unionByName(items.join(added, ["id", "site", "seq"]).select("id", "site", F.col("by").alias("intent_seq"), "data"))
    keys = ["id", "site", "intent_seq"]
    return intents.where(F.col("verb").isin(*_POP)).select(*keys, "verb").join(values, keys, "left")


_VISIBLE = {
    "s": lambda p: R.set_aw(p).select("id", F.col("data").alias("key")),
    "m": lambda p: R.map_aw_mvr(p).select("id", F.col("data.key").alias("key")),
    "l": lambda p: R.list_unsorted(p).select("id", F.col("pos").alias("key")),
}


def clear_effects(
    intents: DataFrame, present: DataFrame, own: DataFrame, kind: str, width: int = WIDTH
) -> DataFrame:
    """One remove per entry visible to the clear; a clear's removes share its sequence.

    ``own`` holds the batch's other effects of this type.  An entry is removed by the
    first clear after it appeared unless the site wrote its key in between.
    """
    clears = intents.where(F.col("verb") == _CLEAR[kind]).select("id", "site", "wall_ms", "intent_seq")
    who = ["id", "site"]
    at = F.struct(F.col("intent_seq").alias("seq"), F.col("wall_ms").alias("wall"))
    first_clear = clears.groupBy(*who).agg(F.min(at).alias("__clear"))
    mine = own.where(F.col("type") == kind).join(first_clear.select(*who), who, "left_semi").select(
        *who, "key", "intent_seq", "op"
    )

    # entries that were there before the batch
    first_write = mine.groupBy(*who, "key").agg(F.min("intent_seq").alias("__write"))
    old = (
        _VISIBLE[kind](present).join(first_clear, "id").join(first_write, [*who, "key"], "left")
        .where("__write is null or __write > __clear.seq")
        .select(*who, "key", "__clear")
    )

    # entries added in the batch
    next_write = prefix_scan(
        mine, [*who, "key"], ["intent_seq"], _bucket("intent_seq", width),
        {"__write": Running("min", F.col("intent_seq"), inclusive=False)}, reverse=True, levels=2,
    )
    marks = clears.select(*who, "intent_seq", at.alias("__mark"))
    both = stable(next_write.unionByName(marks, allowMissingColumns=True))
    upcoming = prefix_scan(
        both, who, ["intent_seq"], _bucket("intent_seq", width),
        {"__clear": Running("min", F.col("__mark"), inclusive=False)}, reverse=True, levels=2,
    )
    new = upcoming.where("op = 'a' and __clear is not null and (__write is null or __write > __clear.seq)").select(
        *who, "key", "__clear"
    )
    return old.unionByName(new).select(
        "id", "key", F.lit(kind).alias("type"), F.lit(None).cast("string").alias("data"), F.lit("r").alias("op"),
        "site", F.col("__clear.wall").alias("wall_ms"), F.col("__clear.seq").alias("intent_seq"),
    )


def effects(
    intents: DataFrame,
    present: DataFrame,
    kinds: tuple[str, ...] = ("r", "s", "m", "c", "l"),
    mode: str = "regular",
    width: int = WIDTH,
    site_digits: int = 1,
) -> DataFrame:
    """Every operation the batch causes.  Name the structure types it touches in
    ``kinds`` to leave out the branches of the others."""
    # Later steps read these several times, so each family is computed and written once.
    parts = {}
    if set(kinds) & {"r", "s", "m"}:
        parts["plain"] = plain_effects(intents)  # a projection, cheap to repeat
    if "c" in kinds:
        parts["c"] = counter_effects(intents, present, width)
    if "l" in kinds:
        parts["l"] = stable(list_effects(intents, present, mode, width, site_digits))
    out = None
    for part in parts.values():
        out = part if out is None else out.unionByName(part)
    for kind in ("s", "m", "l"):
        if kind in kinds:
            own = parts["l"] if kind == "l" else parts["plain"]
            out = out.unionByName(clear_effects(intents, present, own, kind, width))
    return out.select(*EFFECT_COLUMNS)


def events_of(rows: DataFrame) -> DataFrame:
    """One row per intent that causes at least one operation."""
    return rows.groupBy("id", "site", "intent_seq").agg(F.max("wall_ms").alias("wall_ms"))


def stamp_lts(events: DataFrame, rows: DataFrame, n_sites: int, width: int = WIDTH) -> DataFrame:
    """Add ``lts``: the structure's current time, own coordinate advanced per event.

    ``rows`` are all rows the writers see; clocks count per structure, not per key.
    """
    tops = rows.groupBy("id").agg(*[F.max(coord("lts", s)).alias(f"__m{s}") for s in range(1, n_sites + 1)])
    numbered = row_numbers(events, ["id", "site"], ["intent_seq"], _bucket("intent_seq", width), "__n", levels=2)
    lts = [
        (F.coalesce(f"__m{s}", F.lit(0)) + F.when(F.col("site") == s, F.col("__n")).otherwise(0)).cast("long")
        for s in range(1, n_sites + 1)
    ]
    return numbered.join(tops, "id", "left").select(*events.columns, F.array(*lts).alias("lts"))


def stamp_hlc(events: DataFrame, seed: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """Add ``pts``: a hybrid clock per site that never runs behind what the site saw.

    Physical time is the largest wall clock so far; the logical part restarts at 1 when
    it advances and counts up otherwise.  ``seed`` (site, physical_time, logical_time)
    is the clock before the batch.  A site is one long sequence, so both running values
    are bucketed prefix scans.
    """
    order, bucket = ["intent_seq", "id"], _bucket("intent_seq", width)
    rows = prefix_scan(
        events, ["site"], order, bucket,
        {"__before": Running("max", F.col("wall_ms"), inclusive=False), "__n": Running("sum", F.lit(1).cast("long"))}, levels=2,
    )
    if seed is None:
        rows = rows.withColumns({"__p0": F.lit(0).cast("long"), "__l0": F.lit(0)})
    else:
        start = seed.select("site", F.col("physical_time").alias("__p0"), F.col("logical_time").alias("__l0"))
        rows = rows.join(start, "site", "left")
    seen = F.greatest(F.coalesce("__p0", F.lit(0)), F.col("__before"))
    rows = stable(rows.withColumns({
        "__advance": F.when(F.col("wall_ms") > seen, F.col("__n")),
        "__physical": F.greatest(F.col("wall_ms"), seen),
    }))
    rows = prefix_scan(rows, ["site"], order, bucket, {"__start": Running("max", F.col("__advance"))}, levels=2)
    logical = F.when(F.col("__start").isNull(), F.coalesce("__l0", F.lit(0)) + F.col("__n")).otherwise(
        F.col("__n") - F.col("__start") + 1
    )
    return rows.select(*events.columns, hlc(F.col("__physical"), logical).alias("pts"))


def stamp(
    rows: DataFrame, seen: DataFrame, n_sites: int, seed: DataFrame | None = None, width: int = WIDTH
) -> DataFrame:
    """Effects to operations.  ``seen`` are the rows visible to the writers."""
    rows = stable(rows)
    events = stable(stamp_lts(events_of(rows), seen, n_sites, width))
    stamped = stamp_hlc(events, seed, width)
    keys = ["id", "site", "intent_seq"]
    return rows.join(stamped.select(*keys, "lts", "pts"), keys).select(
        "id", "key", "type", "data", "site", "lts", "pts", "op",
        F.col("intent_seq").alias("seq"), F.lit(0).alias("hops"),
        F.col("pts.physical_time").alias("arrival_time"),
    ).select(*OP_COLUMNS)


def run_intents(
    intents: DataFrame,
    present: DataFrame,
    n_sites: int,
    seed: DataFrame | None = None,
    kinds: tuple[str, ...] = ("r", "s", "m", "c", "l"),
    mode: str = "regular",
    width: int = WIDTH,
) -> DataFrame:
    """Intents to log rows ready for ``append_ops`` or ``merge_ops``."""
    return stamp(effects(intents, present, kinds, mode, width, len(str(n_sites))), present, n_sites, seed, width)


def _paths(left: DataFrame, right: DataFrame, start: str) -> DataFrame:
    """Paths (start, outer_id, n) of ``left`` prolonged by those of ``right``, n counting them."""
    far = right.select(F.col("inner_id").alias("outer_id"), F.col("outer_id").alias("__up"), F.col("n").alias("__n"))
    # Counts of a cycle grow without end; they are held where no result could be written.
    n = F.least(F.sum(F.col("n").cast("double") * F.col("__n")), F.lit(1e15)).cast("long")
    return left.join(far, "outer_id").groupBy(start, F.col("__up").alias("outer_id")).agg(n.alias("n"))


def ancestors(ids: DataFrame, links: DataFrame) -> DataFrame:
    """Every structure above each of ``ids`` (id), itself included: (id, outer_id, n paths).

    Pointer doubling: with all paths of up to k - 1 links and those of exactly k, both
    written, one join each gives the double.  A path of more links than there are inner
    structures is a cycle, which is refused.
    """
    step = stable(links.groupBy("inner_id", "outer_id").agg(F.count(F.lit(1)).alias("n")))
    most = step.select("inner_id").distinct().count()
    reach = stable(ids.distinct().select("id", F.col("id").alias("outer_id"), F.lit(1).cast("long").alias("n")))
    length = 1
    while not step.isEmpty():
        if length > most:
            raise ValueError("constraints form a cycle")
        longer = _paths(reach, step, "id")
        reach = stable(reach.unionByName(longer).groupBy("id", "outer_id").agg(F.sum("n").alias("n")))
        step = stable(_paths(step, step, "inner_id"))
        length *= 2
    return reach


def link_integrity(ops: DataFrame, constraints: DataFrame) -> DataFrame:
    """Intents that keep outer entries alive: each local operation on an inner structure
    also adds that structure to its outer one, at the same site and time.

    ``constraints`` is (outer_id, outer_key, inner_id, add_verb).  An added entry can
    itself touch a constrained structure, and so on up; every path of constraints gives its
    own intents.  Constraints that lead from a structure back to itself are refused.
    """
    links = constraints.select("inner_id", "outer_id", "outer_key", "add_verb")
    touched = ops.select("id", "site", F.col("pts.physical_time").alias("wall_ms"), F.col("seq").alias("intent_seq"))
    inner = links.select(F.col("inner_id").alias("id")).distinct()
    above = ancestors(touched.select("id").distinct().join(inner, "id"), links)
    verb, name = F.col("add_verb"), F.col("inner_id")
    added = above.withColumnRenamed("outer_id", "inner_id").join(links, "inner_id").select(
        F.col("id").alias("__touched"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("__path"),
        F.col("outer_id"), verb.alias("verb"),
        F.when(verb == "set_add", name).otherwise(F.col("outer_key")).alias("key"),
        F.when(verb != "set_add", name).alias("value"),
        F.lit(None).cast("long").alias("delta"),
        F.when(verb == "list_insert_at", F.col("outer_key").try_cast("long")).alias("index"),
    )
    return touched.join(added, touched["id"] == added["__touched"]).select(
        F.col("outer_id").alias("id"), "verb", "key", "value", "delta", "index", "site", "wall_ms", "intent_seq")
