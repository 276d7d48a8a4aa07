"""The causal present: operations that no other operation supersedes."""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalog.functions.clocks import coord, vc_eq, vc_lt, vc_lte, vc_sum
from causalog.schema import PAYLOAD_COLUMNS, PRESENT_COLUMNS
from causalog.session import stable

KEYS = ("id", "key")
# Clocks compared together in one task by the exact frontier; larger residues are
# cut into more blocks of about this size.
BLOCK_ROWS = 512
# Near clocks compared together at the end, when hardly any clock is dominated any more.
NEAR_ROWS = 64
# Blocks are found through a tree in which a node has up to 2^FAN_BITS children.
FAN_BITS = 6


def local_and_shared(local: DataFrame, shared: DataFrame) -> DataFrame:
    """Materialised rows plus log rows; log rows carry no merge time."""
    log = shared.select(*PAYLOAD_COLUMNS).withColumn("merged_at", F.lit(None).cast("long"))
    return local.select(*PRESENT_COLUMNS).unionByName(log)


def dedup_ops(ops: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per operation identity (element, site, vector clock).

    Of several copies the one with the smallest other columns stays, so the choice
    does not depend on arrival order.
    """
    identity = [*keys, "site", "lts"]
    rest = [c for c in ops.columns if c not in identity]
    order = F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(c) for c in rest])
    picked = ops.groupBy(*identity).agg(F.min_by(F.struct(*rest), order).alias("__r"))
    return picked.select(*[F.col(c) if c in identity else F.col(f"__r.{c}").alias(c) for c in ops.columns])


def _own(site: str, lts: str) -> Column:
    return coord(lts, F.col(site))


def _preference(columns: list[str], site: str, lts: str) -> Column:
    """Order by own coordinate; among copies prefer merged rows, then a stable pick."""
    merged = -F.coalesce(F.col("merged_at"), F.lit(2**62)) if "merged_at" in columns else F.lit(0).cast("long")
    return F.struct(
        _own(site, lts).alias("own"), merged.alias("m"), F.xxhash64(*[F.col(c) for c in columns]).alias("h")
    )


def causal_present(
    ops: DataFrame,
    n_sites: int,
    keys: tuple[str, ...] = KEYS,
    mode: str = "exact",
    prefilter: bool = False,
    site: str = "site",
    lts: str = "lts",
) -> DataFrame:
    """Rows whose clock no other row of the same element strictly dominates.

    ``mode="causal"`` needs a causally consistent log (see ``audit.check_causal``):
    there the newest row of each site represents that site, so one map-side combined
    aggregation leaves at most ``n_sites`` candidates per element.

    ``mode="exact"`` accepts any clocks.  ``prefilter`` first drops rows that reach
    no coordinate maximum; on logs that are not causal this changes the answer.
    """
    ops = _checked(ops, n_sites, site, lts)
    if prefilter:
        ops = coordinate_max_candidates(ops, n_sites, keys, lts)
    if mode == "causal":
        return _causal_frontier(ops, n_sites, keys, site, lts)
    if mode == "exact":
        return _exact_frontier(ops, n_sites, keys, site, lts)
    raise ValueError(f"unknown mode {mode!r}; expected 'exact' or 'causal'")


def _checked(ops: DataFrame, n_sites: int, site: str, lts: str) -> DataFrame:
    """Fail on rows of a site, or with a clock, that ``n_sites`` has no room for, rather than lose them."""
    fits = F.coalesce(F.col(site).between(1, n_sites) & (F.size(lts) <= n_sites), F.lit(False))
    refuse = F.raise_error(F.lit(f"a row's site or clock does not fit {n_sites} sites"))
    return ops.withColumn(site, F.when(fits, F.col(site)).otherwise(refuse.cast(ops.schema[site].dataType)))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the keys come from the left."""
    other = {k: f"__right_{k}" for k in keys}
    renamed = right.withColumnsRenamed(other)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()])
    return left.join(renamed, same, how).drop(*other.values())


def _causal_frontier(ops: DataFrame, n_sites: int, keys, site: str, lts: str) -> DataFrame:
    columns = ops.columns
    row = F.struct(*[F.col(c) for c in columns if c not in keys])
    order = _preference(columns, site, lts)
    newest = [
        F.max_by(F.when(F.col(site) == s, row), F.when(F.col(site) == s, order)) for s in range(1, n_sites + 1)
    ]
    grouped = ops.groupBy(*keys).agg(F.array_compact(F.array(*newest)).alias("__c"))
    alive = F.filter(
        F.col("__c"),
        lambda x: ~F.exists(F.col("__c"), lambda y: vc_lt(x[lts], y[lts], n_sites)),
    )
    out = grouped.select(*keys, F.explode(alive).alias("__r"))
    return out.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in columns])


def _exact_frontier(ops: DataFrame, n_sites: int, keys, site: str, lts: str) -> DataFrame:
    keys = list(keys)
    columns = ops.columns

    # Rows of one site that agree on all other coordinates form a chain: only its top
    # can survive.  This also removes copies, and it combines map-side.
    ops = ops.withColumn("__site", F.col(site))
    others = F.array(*[
        F.when(F.col(site) == s, F.lit(0).cast("long")).otherwise(coord(lts, s)) for s in range(1, n_sites + 1)
    ])
    row = F.struct(*[F.col(c) for c in columns if c not in keys])
    tops = (
        ops.groupBy(*keys, "__site", others.alias("__others"))
        .agg(F.max_by(row, _preference(columns, site, lts)).alias("__r"))
        .select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in columns])
    )

    # Per element, the clock reaching each coordinate maximum (largest sum on ties) and
    # the one with the largest sum.  All of them are maximal; n_sites + 1 clocks bound
    # the state however many rows the element has.
    total = vc_sum(lts, n_sites)
    scores = [F.struct(coord(lts, s).alias("c"), total.alias("t")) for s in range(1, n_sites + 1)]
    scores.append(F.struct(total.alias("c"), total.alias("t")))
    pivots = tops.groupBy(*keys).agg(
        F.array_distinct(F.array(*[F.max_by(F.col(lts), s) for s in scores])).alias("__pivots")
    )
    judged = join_null_safe(tops, pivots, keys).where(
        ~F.exists("__pivots", lambda p: vc_lt(F.col(lts), p, n_sites))
    )
    judged = judged.withColumn("__suspect", ~F.exists("__pivots", lambda p: vc_eq(F.col(lts), p, n_sites)))
    judged = stable(judged.drop("__pivots"))

    # On a causal log nothing is left to decide.
    suspects = judged.where("__suspect")
    if suspects.isEmpty():
        return judged.select(*columns)
    maximal = _clock_frontier(suspects.select(*keys, lts).distinct(), n_sites, keys, lts)
    kept = join_null_safe(suspects, maximal, [*keys, lts], "left_semi")
    return judged.where("not __suspect").unionByName(kept).select(*columns)


def _clock_frontier(clocks: DataFrame, n_sites: int, keys: list[str], lts: str) -> DataFrame:
    """Distinct clocks no other clock of the same element strictly dominates.

    Elements are cut into hash blocks of bounded size and each block drops what it can
    by itself; this repeats with new blocks while it at least halves the rest.  An
    element that fits one block is then done; the others compare across blocks.
    """
    clocks = stable(clocks)
    turn, size = 0, clocks.count()
    while True:
        blocked = _in_blocks(clocks, keys, lts, turn)
        members = blocked.groupBy(*keys, "__block").agg(
            F.collect_list(lts).alias("__m"), F.max(F.col("__blocks") > 1).alias("__split")
        )
        alive = F.filter("__m", lambda x: ~F.exists("__m", lambda y: vc_lt(x, y, n_sites)))
        left = stable(members.select(*keys, "__split", F.explode(alive).alias(lts)))
        clocks, turn, before, size = left.drop("__split"), turn + 1, size, left.count()
        if left.where("__split").isEmpty():
            return clocks
        if size * 2 > before:
            return join_null_safe(clocks, _dominated_clocks(clocks, n_sites, keys, lts), [*keys, lts], "left_anti")


def _in_blocks(clocks: DataFrame, keys: list[str], lts: str, turn: int) -> DataFrame:
    counts = clocks.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).alias("__blocks"))
    return join_null_safe(clocks, counts, keys).withColumn("__block", F.pmod(F.xxhash64(lts, F.lit(turn)), F.col("__blocks")))


def _dominated_clocks(clocks: DataFrame, n_sites: int, keys: list[str], lts: str) -> DataFrame:
    """Clocks that some other clock of the same element strictly dominates.

    Near clocks share a block; a clock is compared only inside blocks that could hold a
    clock above it.
    """
    blocked = _near_blocks(clocks, n_sites, keys, lts)
    members = blocked.groupBy(*keys, "__block").agg(F.collect_list(lts).alias("__members"))
    return (
        join_null_safe(_probes(blocked, n_sites, keys, lts), members, [*keys, "__block"])
        .where(F.exists("__members", lambda m: vc_lt(F.col(lts), m, n_sites)))
        .select(*keys, lts)
        .distinct()
    )


def _near_blocks(clocks: DataFrame, n_sites: int, keys: list[str], lts: str) -> DataFrame:
    """Clocks with a block number each: runs of at most NEAR_ROWS along a Z-order curve per element.

    The curve only decides which clocks lie together, so its cells may be coarse.
    """
    sites = range(1, min(n_sites, 62) + 1)
    bits = max(1, min(16, 62 // len(sites)))
    ends = clocks.groupBy(*keys).agg(*[
        f(coord(lts, s).cast("double")).alias(f"__{name}{s}") for s in sites for name, f in (("lo", F.min), ("hi", F.max))
    ])
    cells = {}
    for s in sites:
        part = (coord(lts, s).cast("double") - F.col(f"__lo{s}")) / (F.col(f"__hi{s}") - F.col(f"__lo{s}") + 1)
        cells[f"__cell{s}"] = F.least(F.floor(part * (1 << bits)).cast("long"), F.lit((1 << bits) - 1))
    placed = join_null_safe(clocks, ends, keys).withColumns(cells)
    turns = [
        F.shiftleft(F.shiftright(f"__cell{s}", bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(sites) + i)
        for bit in range(bits) for i, s in enumerate(sites)
    ]
    placed = placed.select(*keys, lts, reduce(lambda x, y: x.bitwiseOR(y), turns).alias("__z"))
    n = int(clocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, "__z", lts]
    ranged = placed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    number = F.floor(F.monotonically_increasing_id() / NEAR_ROWS).cast("long")
    return stable(ranged.select(*keys, lts, number.alias("__block")))


def _probes(blocked: DataFrame, n_sites: int, keys: list[str], lts: str) -> DataFrame:
    """Each clock with the blocks it has to be compared in, as ``__block``.

    Whole blocks walk down a tree of bounding corners first: a node is entered only if
    its pointwise maximum is not below the block's minimum and its largest coordinate
    sum is above the block's smallest, as a dominating clock has the larger sum.
    """
    total = vc_sum(lts, n_sites)
    blocks = stable(blocked.groupBy(*keys, "__block").agg(
        F.array(*[F.min(coord(lts, s)) for s in range(1, n_sites + 1)]).alias("__low"), F.min(total).alias("__least"),
        F.array(*[F.max(coord(lts, s)) for s in range(1, n_sites + 1)]).alias("__high"), F.max(total).alias("__most"),
    ))
    last = blocks.agg(F.max("__block")).first()[0] or 0
    visits = blocks.select(*keys, "__block", "__low", "__least", F.lit(0).cast("long").alias("__node"))
    for level in reversed(range(max(1, -(-last.bit_length() // FAN_BITS)))):
        nodes = blocks.groupBy(*keys, F.shiftright("__block", FAN_BITS * level).alias("__child")).agg(
            F.array(*[F.max(coord("__high", s)) for s in range(1, n_sites + 1)]).alias("__high"), F.max("__most").alias("__most")
        )
        below = nodes.groupBy(*keys, F.shiftright("__child", FAN_BITS).alias("__node")).agg(
            F.collect_list(F.struct("__child", "__high", "__most")).alias("__below")
        )
        entered = F.filter(
            "__below", lambda c: vc_lte(F.col("__low"), c["__high"], n_sites) & (F.col("__least") < c["__most"])
        )
        visits = join_null_safe(visits, below, [*keys, "__node"]).select(
            *keys, "__block", "__low", "__least", F.explode(entered).alias("__c")
        ).select(*keys, "__block", "__low", "__least", F.col("__c.__child").alias("__node"), "__c.__high", "__c.__most")
    reached = visits.select(*keys, "__block", "__high", "__most", F.col("__node").alias("__visit"))
    return (
        join_null_safe(blocked, reached, [*keys, "__block"])
        .where(vc_lte(lts, "__high", n_sites) & (total < F.col("__most")))
        .select(*keys, lts, F.col("__visit").alias("__block"))
    )


def coordinate_max_candidates(
    ops: DataFrame, n_sites: int, keys: tuple[str, ...] = KEYS, lts: str = "lts"
) -> DataFrame:
    """Rows that reach the element's maximum in at least one clock coordinate."""
    tops = [F.max(coord(lts, s)).alias(f"__m{s}") for s in range(1, n_sites + 1)]
    maxima = ops.groupBy(*keys).agg(*tops)
    reaches = reduce(or_, [coord(lts, s) == F.col(f"__m{s}") for s in range(1, n_sites + 1)])
    return join_null_safe(ops, maxima, list(keys)).where(reaches).select(*ops.columns)


def present(
    local: DataFrame, shared: DataFrame | None, n_sites: int, read: str = "local", mode: str = "exact"
) -> DataFrame:
    """The readable rows.  ``read="local"`` trusts the materialised table;
    ``read="all"`` also resolves log rows that are not merged yet."""
    if read == "local":
        return local.select(*PRESENT_COLUMNS)
    if read == "all":
        return causal_present(local_and_shared(local, shared), n_sites, mode=mode)
    raise ValueError(f"unknown read mode {read!r}; expected 'local' or 'all'")


def all_rows(local: DataFrame, shared: DataFrame | None, read: str = "local") -> DataFrame:
    """Every row the timestamp computation looks at under a read mode."""
    if read == "local":
        return local.select(*PRESENT_COLUMNS)
    if read == "all":
        return local_and_shared(local, shared)
    raise ValueError(f"unknown read mode {read!r}; expected 'local' or 'all'")


def same_element(left: str, right: str, keys: tuple[str, ...] = KEYS) -> Column:
    return reduce(and_, [F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in keys])
