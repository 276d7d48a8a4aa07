"""Causal present as streaming state: emits which rows enter and leave it."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "type string, data string, site int, lts array<bigint>, physical_time bigint, logical_time int, op string, merged_at bigint"
COLUMNS = [c.split()[0] for c in STATE.split(", ")]
CHANGE = Row("id", "key", "change", *COLUMNS)
OUTPUT = f"id string, key string, change string, {STATE}"


def _below(a, b) -> bool:
    """Every coordinate of a is at most that of b; missing ones are zero."""
    return all(x <= (b[i] if i < len(b) else 0) for i, x in enumerate(a))


def _plain(row: Row) -> tuple:
    return tuple(list(row[c]) if c == "lts" else row[c] for c in COLUMNS)


class FrontierProcessor(StatefulProcessor):
    """Keeps the surviving rows of one element; on causal logs one per site.

    It takes rows, not frames: an element has a few of them in a batch, and frames would cost more than the work.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._rows = handle.getListState("frontier", STATE)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """Rows that are present before the stream begins, one a call; they are no changes."""
        self._rows.appendValue(_plain(initialState))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = [tuple(list(v) if i == 3 else v for i, v in enumerate(r)) for r in self._rows.get()]
        now = list(before)
        for new in map(_plain, rows):
            if any(_below(new[3], old[3]) for old in now if not (old[3] == new[3] and old[2] != new[2])):
                continue
            now = [old for old in now if old[3] == new[3] or not _below(old[3], new[3])] + [new]
        gone = [("out", r) for r in before if r not in now]
        added = [("in", r) for r in now if r not in before]
        if gone or added:
            self._rows.put(now)
        for change, r in gone + added:
            yield CHANGE(*key, change, *r)

    def close(self) -> None:
        pass


def combine(ops: DataFrame) -> DataFrame:
    """Drop rows another row of the same site and Arrow batch supersedes.

    On a causal log the newest row of a site stands for the older ones, so a hot element
    reaches its state as a few rows per batch instead of all of them.
    """
    def newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [lts[site - 1] if site <= len(lts) else 0 for lts, site in zip(pdf["lts"], pdf["site"])]
            yield pdf.loc[pdf.assign(own=own).groupby(["id", "key", "site"])["own"].idxmax()]

    return ops.mapInPandas(newest, ops.schema)


def _flat(rows: DataFrame, merged_at: str) -> DataFrame:
    return rows.select(
        "id", "key", "type", "data", "site", "lts", "pts.physical_time", "pts.logical_time", "op", F.col(merged_at).alias("merged_at"))


def present_stateful(ops: DataFrame, causal: bool = False, present: DataFrame | None = None) -> DataFrame:
    """Changes of the causal present per element: (id, key, change in/out, row).

    Needs the RocksDB state store.  ``causal`` lets rows combine before the shuffle.
    ``present`` is a table of resolved rows the stream's first run starts from; its rows
    leave as changes when something supersedes them, but do not enter.
    """
    flat = _flat(ops, "arrival_time")
    flat = combine(flat) if causal else flat
    start = None if present is None else _flat(present, "merged_at").groupBy("id", "key")
    return flat.groupBy("id", "key").transformWithState(
        statefulProcessor=FrontierProcessor(), outputStructType=OUTPUT, outputMode="update", timeMode="none", initialState=start
    )
