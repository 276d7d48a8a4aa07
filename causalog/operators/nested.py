"""Nested documents: structures whose values are ids of further structures.

``path`` names one conflict view per level, outermost first.  Documents are folded from
the innermost level up, so a structure shared by many parents is rendered once and each
level costs one join and one aggregation by structure.
"""

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalog.operators import resolve as R
from causalog.plans.scan import Running, prefix_scan, sorted_buckets
from causalog.session import stable

_FAMILY = {
    "map_aw_mvr": "map_mvr", "map_rw_mvr": "map_mvr", "map_aw_lww": "map", "map_lww": "map",
    "set_aw": "set", "set_rw": "set", "set_lww": "set",
    "register_mvr": "register_mvr", "register_lww": "register", "list": "list", "counter": "counter",
}


def validate_path(path: list[str]) -> list[str]:
    """The path with normalised view names.  Counters hold no ids, so only the last
    level may be one.  CamelCase names are accepted."""
    if not path:
        raise ValueError("a path needs at least one view")
    names = [re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower() for name in path]
    for i, name in enumerate(names):
        if name not in _FAMILY:
            raise ValueError(f"unknown view {path[i]!r}")
        if _FAMILY[name] == "counter" and i < len(names) - 1:
            raise ValueError(f"{path[i]!r} holds no ids and can only be the last level")
    return names


def _entries(name: str, present: DataFrame) -> DataFrame:
    """(id, slot, ord, value): one row per value, in the order it is rendered.

    ``slot`` is the map key or list position, ``ord`` the place among several values.
    """
    rows, family = R.VIEWS[name](present), _FAMILY[name]
    none, zero = F.lit(None).cast("string"), F.lit(0)
    if family == "map":
        return rows.select("id", F.col("data.key").alias("slot"), zero.alias("ord"), F.col("data.value").alias("value"))
    if family == "map_mvr":
        return rows.select("id", F.col("data.key").alias("slot"), F.posexplode("data.value").alias("ord", "value"))
    if family == "register_mvr":
        return rows.select("id", none.alias("slot"), F.posexplode("data").alias("ord", "value"))
    if family == "list":
        return rows.select("id", F.col("pos").alias("slot"), zero.alias("ord"), F.col("data").alias("value"))
    return rows.select("id", none.alias("slot"), zero.alias("ord"), F.col("data").cast("string").alias("value"))


def quote(text: Column) -> Column:
    """JSON string literal; NULL becomes null."""
    boxed = F.to_json(F.array(text))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def _array(items: Column) -> Column:
    """JSON array text of collected (order..., json) structs."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(items), lambda x: x["json"]), ","), F.lit("]"))


def _object(items: Column) -> Column:
    """JSON object text; keys sorted shortest first, then bytewise."""
    pairs = F.transform(F.array_sort(items), lambda x: F.concat(quote(x["key"]), F.lit(":"), x["json"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _fold(family: str, rows: DataFrame) -> DataFrame:
    """(id, slot, ord, value, json) to one JSON text per id."""
    if family in ("register", "counter"):
        return rows.select("id", "json")
    if family == "map_mvr":
        rows = rows.groupBy("id", "slot").agg(_array(F.collect_list(F.struct("ord", "json"))).alias("json"))
    if family in ("map", "map_mvr"):
        item = F.struct(F.octet_length("slot").alias("n"), F.col("slot").alias("key"), F.col("json"))
        return rows.groupBy("id").agg(_object(F.collect_list(item)).alias("json"))
    order = {"list": "slot", "set": "value", "register_mvr": "ord"}[family]
    return rows.groupBy("id").agg(_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("json")))).alias("json"))


def _levels(present: DataFrame, names: list[str], roots: DataFrame | None) -> list[DataFrame]:
    """Entries per level.  With ``roots``, each level resolves only reachable structures;
    every level is then written once, because it feeds both the next level and the fold."""
    if roots is None:
        return [_entries(name, present) for name in names]
    out, ids = [], roots.select("id").distinct()
    for name in names:
        rows = stable(_entries(name, present.join(ids, "id", "left_semi")))
        out.append(rows)
        ids = rows.select(F.col("value").alias("id")).distinct()
    return out


def nested_json(present: DataFrame, path: list[str], roots: DataFrame | None = None) -> DataFrame:
    """One JSON document per outermost structure: (id, data).

    Maps become objects, sets and lists arrays, a counter a number, everything else a
    string.  An entry pointing at a structure without rows is left out.
    """
    names = validate_path(path)
    levels = _levels(present, names, roots)
    leaf = F.col("value") if names[-1] == "counter" else quote(F.col("value"))
    docs = _fold(_FAMILY[names[-1]], levels[-1].withColumn("json", leaf))
    for name, rows in zip(reversed(names[:-1]), reversed(levels[:-1])):
        linked = rows.join(docs.withColumnRenamed("id", "value"), "value")
        docs = _fold(_FAMILY[name], linked)
    return docs.select("id", F.col("json").alias("data"))


def _brackets(family: str) -> list[tuple[str, str, list[Column], bool]]:
    """The brackets around one value of a level: opening, closing, sort columns, whether the last of these labels it."""
    keyed = ("{", "}", [F.octet_length("slot"), F.col("slot")], True)
    order = {"list": ["slot", "value", "copy"], "set": ["value"], "register_mvr": ["ord"], "map_mvr": ["ord"]}.get(family)
    listed = [("[", "]", [F.col(c) for c in order], False)] if order else []
    return ([keyed] if family in ("map", "map_mvr") else []) + listed


def _leaves(levels: list[DataFrame], names: list[str]) -> tuple[DataFrame, list[tuple[str, str, list[str], bool]]]:
    """(id, sort columns of every bracket, json): one row per innermost value, and the brackets from outside in."""
    out, brackets = None, []
    for i, (name, rows) in enumerate(zip(names, levels)):
        if _FAMILY[name] == "list":  # equal entries at one position stay apart
            same = rows.groupBy("id", "slot", "value").agg(F.count(F.lit(1)).alias("n"))
            rows = same.select("id", "slot", "value", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
        here = []
        for opening, closing, order, labelled in _brackets(_FAMILY[name]):
            columns = [f"__k{len(brackets)}_{j}" for j in range(len(order))]
            here += [c.alias(n) for c, n in zip(order, columns)]
            brackets.append((opening, closing, columns, labelled))
        rows = rows.select(F.col("id").alias("__of"), F.col("value").alias("__value"), *here)
        if out is None:
            out = rows.withColumnRenamed("__of", "id")
        else:
            out = out.withColumnRenamed("__value", "__of").join(rows, "__of").drop("__of")
    leaf = F.col("__value") if names[-1] == "counter" else quote(F.col("__value"))
    return out.withColumn("json", leaf).drop("__value"), brackets


def nested_chunks(present: DataFrame, path: list[str], roots: DataFrame | None = None, chars: int = 1 << 18) -> DataFrame:
    """The documents of ``nested_json`` as ordered pieces of text: (id, part, text).

    Every part but a document's last has ``chars`` characters; the parts in order make up
    the document.  No task and no row holds a document: the innermost values are sorted
    over all tasks, each value writes the brackets, keys and commas between it and the
    value before, and a running length says in which part it lies.  List entries at one
    position stand in the order of their values.  Runs jobs when called.
    """
    names = validate_path(path)
    leaves, brackets = _leaves(_levels(present, names, roots), names)
    columns = [c for _, _, order, _ in brackets for c in order]
    # Read by the ends and twice by the range sort: the joins above are run once.
    leaves = stable(leaves.withColumn("__end", F.lit(0)))
    ends = leaves.select("id").distinct().withColumn("__end", F.lit(1))
    order = ["id", "__end", *columns]
    ranged = sorted_buckets(leaves.unionByName(ends, allowMissingColumns=True), order)
    before = prefix_scan(
        ranged, ["id"], order[1:], F.col("__range"),
        {"__before": Running("last", F.struct(F.lit(True).alias("there"), *columns), inclusive=False),
         "__row": Running("sum", F.lit(1).cast("long"))}, levels=2,
    )

    def label(i: int) -> Column:
        _, _, of, labelled = brackets[i]
        return F.concat(quote(F.col(of[-1])), F.lit(":")) if labelled else F.lit("")

    def opened(i: int) -> list[Column]:
        return [x for k in range(i, len(brackets)) for x in (F.lit(brackets[k][0]), label(k))]

    def closed(i: int) -> Column:
        return F.lit("".join(b[1] for b in reversed(brackets[i:])))

    text = F.when(F.col("__end") == 1, closed(0)).when(F.col("__before").isNull(), F.concat(F.lit(""), *opened(0)))
    for i, (_, _, of, _) in enumerate(brackets):
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__before.{c}")) for c in of])
        text = text.when(~same, F.concat(closed(i + 1), F.lit(","), label(i), *opened(i + 1)))
    piece = F.concat(F.coalesce(text, F.lit("")), F.coalesce("json", F.lit("")))
    # From here on a row's number stands for its sort columns.
    pieces = stable(before.select("id", "__row", "__range", piece.alias("__piece")))
    placed = prefix_scan(
        pieces, ["id"], ["__row"], F.col("__range"),
        {"__at": Running("sum", F.length("__piece").cast("long"), inclusive=False)}, levels=2,
    ).select("id", "__piece", F.coalesce("__at", F.lit(0)).alias("__at"), F.length("__piece").alias("__n")).where("__n > 0")
    size, at, upto = F.lit(chars).cast("long"), F.col("__at"), F.col("__at") + F.col("__n")
    cut = placed.withColumn("part", F.explode(F.sequence(F.floor(at / size), F.floor((upto - 1) / size))))
    first, last = F.greatest(at, F.col("part") * size), F.least(upto, (F.col("part") + 1) * size)
    cut = cut.select("id", "part", F.struct(
        first.alias("at"), F.col("__piece").substr((first - at + 1).cast("int"), (last - first).cast("int")).alias("text")
    ).alias("__p"))
    held = F.transform(F.array_sort(F.collect_list("__p")), lambda x: x["text"])
    return cut.groupBy("id", "part").agg(F.array_join(held, "").alias("text"))


def nested_rows(present: DataFrame, path: list[str], roots: DataFrame | None = None) -> DataFrame:
    """The flat path table: id<n> and key<n> or pos<n> per level, then the last data."""
    names = validate_path(path)
    levels = _levels(present, names, roots)
    out, columns = None, []
    for i, (name, rows) in enumerate(zip(names, levels)):
        family = _FAMILY[name]
        here = [f"id{i}"]
        if family in ("map", "map_mvr"):
            here.append(f"key{i}")
        elif family == "list":
            here.append(f"pos{i}")
        rows = rows.select(F.col("id").alias(f"id{i}"), F.col("slot").alias(here[-1] if len(here) > 1 else "__slot"),
                           F.col("value").alias("data"))
        rows = rows.select(*here, "data")
        out = rows if out is None else out.withColumnRenamed("data", f"id{i}").join(rows, f"id{i}")
        columns += here
    return out.select(*columns, "data")
