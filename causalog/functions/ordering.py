"""Sort keys with SQL NULL placement (NULL is larger than every value).

Each function returns a struct usable inside ``min_by``/``array_sort``, so a winner
can be chosen by a map-side combined aggregate instead of a window.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def asc(col: Column) -> Column:
    """Ascending, NULLs last."""
    return F.struct(col.isNull().alias("n"), col.alias("v"))


def desc_number(col: Column) -> Column:
    """Descending, NULLs first, for numeric columns."""
    return F.struct(col.isNotNull().alias("n"), (-col).alias("v"))


def newest_first(pts: Column) -> Column:
    return F.struct(
        pts.isNotNull().alias("n"),
        desc_number(pts["physical_time"]).alias("p"),
        desc_number(pts["logical_time"]).alias("l"),
    )
