"""List positions: strings ordered bytewise, with room for more between any two.

Printable characters are digits.  A missing digit counts as the smallest character on
the left bound and as one past the largest on the right bound.  Positions for a whole
batch are computed from the rank of each new element, so n elements in one gap get
strings of O(log n) length.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalog.sources.ops import expand_range

# Fixed values of the position alphabet.
FIRST_CHAR = 33   # '!' pads the left bound
PAST_LAST = 127   # pads the right bound
DIGITS = 93       # characters usable after the first: '"' .. '~', never a trailing '!'
MAX_EXTRA = 8

MODES = ("regular", "appends", "prepends")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _code(text: Column, i: Column, missing: int) -> Column:
    return F.when(i < F.length(text), F.ascii(F.substring(text, i + 1, 1))).otherwise(missing)


def with_gap(df: DataFrame, lo: str, hi: str, n: str, site: str, site_digits: int = 1) -> DataFrame:
    """Add what all new positions of one gap share.  One row per gap is enough.

    Site numbers are written with ``site_digits`` digits, so that no position with one
    site's number can equal another position with another site's.
    """
    left, right = F.coalesce(lo, F.lit("")), F.coalesce(hi, F.lit(""))
    places = F.sequence(F.lit(0), F.greatest(F.length(left), F.length(right)))
    split = F.array_min(F.filter(places, lambda i: _code(right, i, PAST_LAST) - _code(left, i, FIRST_CHAR) > 1))
    df = df.withColumn("__split", split)
    at = F.col("__split")
    df = df.withColumn("__first", _code(left, at, FIRST_CHAR) + 1)
    df = df.withColumn("__choices", (_code(right, at, PAST_LAST) - F.col("__first")).cast("long"))
    narrow = F.raise_error(F.lit("more positions than one gap can take")).cast("int")
    extra = F.coalesce(*[F.when(F.col("__choices") * F.lit(DIGITS**w) >= F.col(n), F.lit(w)) for w in range(MAX_EXTRA + 1)], narrow)
    number = F.col(site).cast("string")
    wide = F.raise_error(F.lit(f"a site number has more than {site_digits} digits"))
    suffix = F.when(F.length(number) <= site_digits, F.lpad(number, site_digits, "0")).otherwise(wide)
    df = df.withColumns({"__extra": extra, "__prefix": F.rpad(left, at, chr(FIRST_CHAR)), "__suffix": suffix})
    powers = F.array(*[F.lit(DIGITS**w).cast("long") for w in range(MAX_EXTRA + 1)])
    return df.withColumn("__power", F.get(powers, F.col("__extra")))


def position_at(n: str, rank: str, mode: str = "regular") -> Column:
    """The rank-th (from 1) of n new positions in a gap prepared by ``with_gap``.

    ``regular`` spreads the positions evenly, ``appends`` packs them after the left
    bound, ``prepends`` before the right one.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; expected one of {MODES}")
    n, rank = F.col(n).cast("long"), F.col(rank).cast("long")
    room = F.col("__choices") * F.col("__power")
    if mode == "regular":
        step, left = _div(room, n + 1), room % (n + 1)
        value = rank * step + _div(rank * left + n, n + 1) - 1
    elif mode == "appends":
        value = rank - 1
    else:
        value = room - n + rank - 1
    digits = [
        F.when(F.col("__extra") > w, F.char(_div(value, F.lit(DIGITS**w)) % DIGITS + FIRST_CHAR + 1)).otherwise("")
        for w in reversed(range(MAX_EXTRA))
    ]
    head = F.char(F.col("__first") + _div(value, F.col("__power")))
    return F.concat(F.col("__prefix"), head, *digits, F.col("__suffix"))


def bulk_positions(lists: DataFrame, mode: str = "regular", site_digits: int = 1) -> DataFrame:
    """Rows (id, lo, hi, n, site) to n ordered positions each: (id, rank, pos).

    Positions lie strictly between the bounds; an empty or NULL bound is the end of the
    list.  The site number is appended, with ``site_digits`` digits, which keeps positions
    of different sites apart.
    """
    rows = expand_range(with_gap(lists, "lo", "hi", "n", "site", site_digits), "n", "__i", ["id"])
    rows = rows.withColumn("rank", F.col("__i") + 1)
    return rows.select("id", "rank", position_at("n", "rank", mode).alias("pos"))
