"""A batch of list edits in which every edit sees the site's earlier ones.

An edit names its place by an index into the list as its site has left it.  What a run of
edits does to a list of known length does not depend on the list's elements: it is a row
of *items*, each either a stretch of the old list, kept or removed, or a new element.
Such rows compose, and composition is associative, so a site's edits of one list are cut
into blocks, every block is worked out by itself, and neighbouring blocks are composed
in rounds, halving their number.  No task holds more than one block; a composition is
running sums over the items and a merge by coordinates.  A sequence of one block takes no
part in the rounds.

A new element stands directly behind the element left of it, removed ones after that
notwithstanding.  Only the lengths of the list run through the blocks of a site in order;
each block gives the next one's length by a step function of its own.

Items (id, site, blk, ord, seq, lo, width, live, by): ``seq`` is the inserting intent, or
NULL for ``width`` old elements from ``lo`` on; ``by`` is the removing intent, or CLEARED.
Placed items have the coordinates they start at in the old (``old``) and the new (``new``) list.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalog.plans.scan import Running, prefix_scan, row_numbers, sorted_buckets
from causalog.session import stable

#: Edits of one sequence worked out by one task at a time.
BLOCK = 1 << 16

#: Coordinates, or items, in one bucket of the running sums.
WIDTH = 1 << 16

#: In place of a removing intent: a clear took the element.
CLEARED = -1

INSERT, REMOVE, POP_LAST, CLEAR = range(4)
_FAR = 1 << 62
_CHUNK = 64
_SEQUENCE = ["id", "site"]
_STEPS = "id string, site int, blk long, size long, fixed boolean, base long, flats array<long>"
_PLACED = "id string, site int, blk long, ord long, seq long, lo long, width long, live boolean, by long, old long, new long"


def coded(intents: DataFrame) -> DataFrame:
    """List intents as (id, site, intent_seq, code, at).  An insert without an index appends, one
    before the list prepends; a remove without a place in the list does nothing."""
    verb = F.col("verb")
    code = (
        F.when(verb.isin("list_insert_at", "list_append", "list_prepend"), INSERT).when(verb.isin("list_rmv", "list_pop_first"), REMOVE)
        .when(verb == "list_pop_last", POP_LAST).when(verb == "list_clear", CLEAR)
    )
    index = F.col("index").cast("long")
    at = (
        F.when(verb == "list_insert_at", F.coalesce(F.greatest(index, F.lit(0)), F.lit(_FAR))).when(verb == "list_append", _FAR)
        .when(verb == "list_rmv", F.coalesce(index, F.lit(-1))).otherwise(0)
    )
    return intents.select(*_SEQUENCE, "intent_seq", code.alias("code"), at.cast("long").alias("at")).where("code is not null")


def length_steps(codes, places) -> tuple[bool, int, list[int]]:
    """(fixed, base, flats) of the length after some edits as a function f of the length s before.

    f(s) = base if fixed, else s + base - (number of flats below s).  An insert adds 1; a
    removal at i takes 1 where the length is above i, which makes one more point flat.
    """
    fixed, base, flats = False, 0, []
    for code, at in zip(codes, places):
        if code == INSERT:
            base += 1
        elif code == CLEAR:
            fixed, base, flats = True, 0, []
        elif at >= 0:
            if base > at:
                base -= 1
            elif not fixed:
                lo, hi = 0, len(flats)  # how many flats lie below the last s with f(s) = at
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if flats[mid] - mid <= at - base else (lo, mid)
                flats.insert(lo, at - base + lo)
    return fixed, base, flats


class Items:
    """The items of one block, in chunks so that finding and inserting stay short."""

    def __init__(self, size: int):
        self.size = size
        self.chunks = [[[None, 0, size, True, None]]] if size else [[]]
        self.lengths = [size]

    @staticmethod
    def _length(item) -> int:
        return 0 if not item[3] else item[2] if item[0] is None else 1

    def _find(self, i: int) -> tuple[int, int, int]:
        """Chunk, place in it and offset of the live element ``i``."""
        c = 0
        while i >= self.lengths[c]:
            i -= self.lengths[c]
            c += 1
        k = 0
        for item in self.chunks[c]:
            n = self._length(item)
            if i < n:
                return c, k, i
            i -= n
            k += 1
        raise IndexError(i)

    def _put(self, c: int, k: int, items: list, drop: int = 0) -> None:
        chunk = self.chunks[c]
        chunk[k:k + drop] = items
        if len(chunk) > 2 * _CHUNK:
            self.chunks[c:c + 1] = [chunk[:_CHUNK], chunk[_CHUNK:]]
            self.lengths[c:c + 1] = [sum(map(self._length, part)) for part in self.chunks[c:c + 2]]
        else:
            self.lengths[c] = sum(map(self._length, chunk))

    def insert(self, i: int, seq: int) -> None:
        new = [seq, None, 0, True, None]
        self.size += 1
        if i == 0:
            return self._put(0, 0, [new])
        c, k, at = self._find(i - 1)
        old = self.chunks[c][k]
        if old[0] is None and at + 1 < old[2]:
            self._put(c, k, [[None, old[1], at + 1, True, None], new, [None, old[1] + at + 1, old[2] - at - 1, True, None]], 1)
        else:
            self._put(c, k + 1, [new])

    def remove(self, i: int, by: int) -> None:
        c, k, at = self._find(i)
        old = self.chunks[c][k]
        self.size -= 1
        if old[0] is not None:
            return self._put(c, k, [[old[0], None, 0, False, by]], 1)
        parts = [[None, old[1], at, True, None], [None, old[1] + at, 1, False, by], [None, old[1] + at + 1, old[2] - at - 1, True, None]]
        self._put(c, k, [p for p in parts if p[2]], 1)

    def clear(self) -> None:
        for chunk in self.chunks:
            for item in chunk:
                if item[3]:
                    item[3:] = [False, CLEARED]
        self.lengths, self.size = [0] * len(self.chunks), 0

    def __iter__(self):
        return (item for chunk in self.chunks for item in chunk)


def worked_out(size: int, seqs, codes, places) -> Items:
    items = Items(size)
    for seq, code, at in zip(seqs, codes, places):
        if code == INSERT:
            items.insert(min(at, items.size), seq)
        elif code == CLEAR:
            items.clear()
        else:
            at = items.size - 1 if code == POP_LAST else at
            if 0 <= at < items.size:
                items.remove(at, seq)
    return items


def _by_block(one, columns, schema):
    """A function for mapInPandas over rows sorted by block; ``one`` gets the ``columns`` of a block's rows
    as lists and yields rows of ``schema``.  Most blocks are short: frames are made per batch, not per block."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {c.split()[0]: {"long": "Int64", "int": "Int64", "boolean": "boolean"}.get(c.split()[1], "object") for c in schema.split(", ")}

    def made(frame, bounds):
        lists = [frame[c].tolist() for c in columns]
        rows = [row for a, b in zip(bounds, bounds[1:]) for row in one(*[x[a:b] for x in lists])]
        return pd.DataFrame({c: pd.Series(list(x), dtype=kinds[c]) for c, x in zip(names, zip(*rows) if rows else [()] * len(names))})

    def run(frames):
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            keys = frame[[*_SEQUENCE, "blk"]]
            starts = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            if len(starts) > 1:
                yield made(frame, starts)
            held = frame.iloc[starts[-1]:] if len(starts) else None
        if held is not None and len(held):
            yield made(held, [0, len(held)])
    return run


def _block_steps(id, site, blk, size, least, most, codes, places):
    fixed, base, flats = length_steps(codes, places)
    # Flats the length cannot reach are the same for all lengths it can have here.
    below, above = np.searchsorted(flats, least[0]), np.searchsorted(flats, most[0])
    yield id[0], site[0], blk[0], size[0], fixed, base - int(below), flats[below:above]


def _lengths(frames):
    """Rows of steps, sorted by sequence and block, to the length each block starts from."""
    at, length = None, 0
    for frame in frames:
        out = []
        for id, site, blk, size, fixed, base, flats in frame[["id", "site", "blk", "size", "fixed", "base", "flats"]].itertuples(index=False):
            if (id, site) != at:
                at, length = (id, site), size
            length = base if fixed else length + base - int(np.searchsorted(flats, length))
            out.append((id, site, blk + 1, length))
        yield pd.DataFrame(out, columns=["id", "site", "blk", "length"])


def _block_items(id, site, blk, length, seqs, codes, places):
    old = new = 0
    for ord, (seq, lo, width, live, by) in enumerate(worked_out(length[0], seqs, codes, places)):
        yield id[0], site[0], blk[0], ord, seq, lo, width, live, by, old, new
        old += width
        new += 0 if not live else width if seq is None else 1


def _tasks(df: DataFrame) -> int:
    """As many as are set: the work of a row of edits is not in proportion to its bytes, by which adaptive execution would join them."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _starting_lengths(edits: DataFrame) -> DataFrame:
    """The length every block but the first of its sequence starts from."""
    blocks = edits.groupBy(*_SEQUENCE, "blk").agg(
        F.first("size").alias("size"), F.sum((F.col("code") == INSERT).cast("long")).alias("in"),
        F.sum(F.col("code").isin(REMOVE, POP_LAST).cast("long")).alias("out"), F.max((F.col("code") == CLEAR).cast("int")).alias("clear"))
    reach = prefix_scan(
        blocks, _SEQUENCE, ["blk"], F.floor(F.col("blk") / WIDTH),
        {"__in": Running("sum", F.col("in"), False), "__out": Running("sum", F.col("out"), False), "__clear": Running("max", F.col("clear"), False)}, levels=2)
    most = F.col("size") + F.coalesce("__in", F.lit(0))
    least = F.when(F.col("__clear") == 1, 0).otherwise(F.greatest(most - F.coalesce("__out", F.lit(0)), F.lit(0)))
    reach = reach.select(*_SEQUENCE, "blk", least.cast("long").alias("least"), most.alias("most"))
    last = edits.groupBy(*_SEQUENCE).agg(F.max("blk").alias("__last"))
    before = edits.join(last, _SEQUENCE).where("blk < __last").drop("__last").join(reach, [*_SEQUENCE, "blk"])
    order = [*_SEQUENCE, "blk"]
    columns = [*order, "size", "least", "most", "code", "at"]
    steps = before.repartition(_tasks(edits), *order).sortWithinPartitions(*order, "intent_seq").mapInPandas(_by_block(_block_steps, columns, _STEPS), _STEPS)
    return steps.repartition(*_SEQUENCE).sortWithinPartitions(*order).mapInPandas(_lengths, "id string, site int, blk long, length long")


def _length() -> Column:
    """Elements an item has in the new list."""
    return F.when(~F.col("live"), 0).when(F.col("seq").isNull(), F.col("width")).otherwise(1).cast("long")


def _placed(items: DataFrame) -> DataFrame:
    """Items with their coordinates."""
    rows = items.withColumn("__n", _length())
    placed = prefix_scan(
        rows, [*_SEQUENCE, "blk"], ["ord"], F.floor(F.col("ord") / WIDTH),
        {"old": Running("sum", F.col("width"), False), "new": Running("sum", F.col("__n"), False)}, levels=2)
    return placed.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("old", "new")})


def composed(items: DataFrame) -> DataFrame:
    """Every two neighbouring blocks of placed items as one: what the second does to the list the first leaves."""
    group = [*_SEQUENCE, "pair"]
    rows = stable(items.withColumn("__n", _length()).withColumn("pair", F.floor(F.col("blk") / 2)).withColumn("second", F.col("blk") % 2 == 1))
    first, second = rows.where("not second"), rows.where("second")
    # Stretches of the list in between, cut at the items of both sides.
    a = first.where("live").select(*group, F.col("new").alias("coord"), F.struct("new", "__n", "seq", "lo").alias("a"), F.lit(None).cast("struct<lo:bigint,width:bigint,live:boolean,by:bigint>").alias("b"))
    b = second.where("seq is null").select(*group, F.col("lo").alias("coord"), F.lit(None).cast(a.schema["a"].dataType).alias("a"), F.struct("lo", "width", "live", "by").alias("b"))
    cut = a.unionByName(b).groupBy(*group, "coord").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    cut = prefix_scan(cut, group, ["coord"], F.floor(F.col("coord") / WIDTH), {"a": Running("last", F.col("a")), "b": Running("last", F.col("b"))}, levels=2)
    old = F.col("a.seq").isNull()
    size = F.least(F.col("a.new") + F.col("a.__n"), F.col("b.lo") + F.col("b.width")) - F.col("coord")
    met = cut.select(
        *group, "coord", F.lit(2).alias("cls"), F.lit(0).cast("long").alias("ord"), F.col("a.seq").alias("seq"),
        F.when(old, F.col("a.lo") + F.col("coord") - F.col("a.new")).alias("lo"), F.when(old, size).otherwise(0).cast("long").alias("width"),
        # A block without a second one stays as it is.
        F.when(F.col("b").isNull(), True).otherwise(F.col("b.live")).alias("live"), F.col("b.by").alias("by"))
    # Behind the element left of a coordinate: new elements first, then those the first block removed.
    kept = ["seq", "lo", "width", "live", "by"]
    gone = first.where("not live").select(*group, F.col("new").alias("coord"), F.lit(1).alias("cls"), "ord", *kept)
    born = second.where("seq is not null").select(*group, F.col("old").alias("coord"), F.lit(0).alias("cls"), "ord", *kept)
    order = ["coord", "cls", "ord"]
    ranged = sorted_buckets(met.unionByName(gone).unionByName(born), [*group, *order])
    numbered = row_numbers(ranged, group, order, F.col("__range"), "__ord", levels=2)
    return _placed(stable(numbered.select(*_SEQUENCE, F.col("pair").alias("blk"), (F.col("__ord") - 1).alias("ord"), *kept)))


def list_items(intents: DataFrame, sizes: DataFrame, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """Items of all edits of every (id, site), with ``old``, the number of old elements before.

    ``sizes`` is (id, __size); a list not in it is empty.  Removed old elements have one
    item each; kept old elements have none.
    """
    rows = coded(intents).join(sizes, "id", "left").withColumn("size", F.coalesce("__size", F.lit(0)).cast("long")).drop("__size")
    rows = row_numbers(rows, _SEQUENCE, ["intent_seq"], F.floor(F.col("intent_seq") / width), "__n", levels=2)
    edits = stable(rows.withColumn("blk", F.floor((F.col("__n") - 1) / block)).drop("__n"))
    blocks = (edits.agg(F.max("blk")).first()[0] or 0) + 1
    order = [*_SEQUENCE, "blk"]
    known = edits.withColumn("length", F.col("size"))
    if blocks > 1:
        # One row for every ``block`` edits at most.
        long = F.broadcast(stable(edits.where("blk > 0").select(*_SEQUENCE).distinct()))
        starts = _starting_lengths(edits.join(long, _SEQUENCE, "left_semi"))
        known = edits.join(starts, order, "left").withColumn("length", F.coalesce("length", "size"))
    columns = [*order, "length", "intent_seq", "code", "at"]
    items = stable(known.repartition(_tasks(edits), *order).sortWithinPartitions(*order, "intent_seq").mapInPandas(
        _by_block(_block_items, columns, _PLACED), _PLACED))
    if blocks > 1:
        short, items = items.join(long, _SEQUENCE, "left_anti"), items.join(long, _SEQUENCE, "left_semi")
        while blocks > 1:
            items, blocks = composed(items), (blocks + 1) // 2
        items = short.unionByName(items.drop("__n"))
    return items.where("seq is not null or not live").select(*_SEQUENCE, "ord", "seq", "lo", "live", "by", "old")
