"""Line deduplication within one edit, through deletion neighbourhoods.

Two lines within one edit (a character put in, left out or changed) become equal when
one place is left out of both, or of the longer.  Every such variant is a hashed key;
lines meet on equal keys, are verified, and the earliest stays.

Variants are only made where they can meet: a line is cut into ``PARTS`` parts, and two
lines within one edit agree on all but one part.  So lines are first keyed by what is
left without each part, and only lines that share such a key, in that part, are given
their one-character variants.  A key carries the place left out, so all lines of a key
are within one edit of each other and only the earliest need be looked at: the work is
linear, however many lines share a key.
"""

from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalog.llm.common import chunks, column, sized_broadcast, stable, text_bytes, written
from causalog.llm.features import SpanHash, code_points, mix

PARTS = 4


def part_keys(hashed: SpanHash, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(lines, 2 PARTS) hashes of what is left without one part.

    Columns below PARTS cut a line of n characters as one of length n, the others as the
    longer partner of one of length n - 1.
    """
    size = ends - starts
    out = []
    for longer in (0, 1):
        m = size - longer
        for j in range(PARTS):
            head, tail = m * j // PARTS, m - m * (j + 1) // PARTS
            a, b = hashed(starts, starts + head), hashed(ends - tail, ends)
            out.append(mix(a * np.uint64(3) + b * np.uint64(5) + (m * PARTS + j).astype(np.uint64)))
    return np.stack(out, 1).astype(np.int64)


#: What a variant is of its line: the line itself, the line without a character, or the
#: line without the character of a given place.
WHOLE, SHORTER, CHANGED = 0, 1, 2


def one_edit_keys(points: np.ndarray, parts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and kinds of a line's one-character variants in the given parts (columns of ``part_keys``).

    Lines with a CHANGED key in common differ at most at one place.  A line's WHOLE key
    is a SHORTER key of the lines that have one character more.
    """
    hashed, n = SpanHash(points), len(points)
    keys = {WHOLE: [], SHORTER: [], CHANGED: []}
    for part in parts:
        longer, j = divmod(part, PARTS)
        m = n - longer
        at = np.arange(m * j // PARTS, min(n, m * (j + 1) // PARTS + longer))
        if longer:
            keys[SHORTER].append(hashed.without(0, n, at, 1))
        else:
            keys[CHANGED].append(mix(hashed.without(0, n, at, 2) + at.astype(np.uint64)))
            keys[WHOLE] = [hashed(np.array([0]), np.array([n]), 1)]
    found = [np.unique(np.concatenate(k)) if k else np.zeros(0, np.uint64) for k in keys.values()]
    return np.concatenate(found).astype(np.int64), np.repeat(np.array(list(keys), np.int8), [len(k) for k in found])


def within_one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def _lines(least: int):
    """Per line (id, th, no): its digest, null if blank, and its part keys, none if shorter than ``least`` characters."""

    def run(batches):
        for batch in batches:
            data, at = text_bytes(batch.column(2))
            for lo, hi in chunks(at):
                own = at[lo:hi + 1]
                raw = data[own[0]:own[-1]]
                byte_at = own - own[0]
                points, place = code_points(raw, byte_at)
                cuts = np.flatnonzero(points == 10)
                # A text of k line feeds has k + 1 lines; in order, starts and ends pair up.
                starts, ends = np.sort(np.concatenate([place[:-1], cuts + 1])), np.sort(np.concatenate([cuts, place[1:]]))
                n_lines = np.bincount(np.searchsorted(place, cuts, "right") - 1, minlength=hi - lo) + 1
                doc = np.repeat(np.arange(hi - lo), n_lines)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
                whole = raw.tobytes()
                digests = [
                    blake2b(line, digest_size=16).digest() if line.strip() else None
                    for x, y in zip(byte_at.tolist(), byte_at[1:].tolist()) for line in whole[x:y].split(b"\n")]
                keyed = (ends - starts >= least) & np.array([d is not None for d in digests], bool)
                keys = part_keys(SpanHash(points), starts, ends)[keyed]
                offsets = np.concatenate([[0], np.cumsum(keyed)]) * 2 * PARTS
                row = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(row), batch.column(1).take(row), pa.array(number, pa.int32()), pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel())),
                ], ["id", "th", "no", "digest", "keys"])
    return run


def _variants(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        firsts, keys, kinds = [], [], []
        texts, parts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for i, (text, own) in enumerate(zip(texts, parts)):
            key, kind = one_edit_keys(np.frombuffer(text.encode("utf-32-le"), np.uint32), own)
            keys.append(key)
            kinds.append(kind)
            firsts.append(np.full(len(key), i))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys)), pa.array(np.concatenate(kinds)), batch.column(0).take(pa.array(np.concatenate(firsts)))],
            ["key", "kind", "first"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """One row per input row: id, n_lines, kept (line numbers), text (the lines kept).

    Lines are cut at line feeds.  A line goes if an earlier line is equal, or if both have
    at least ``least`` characters and are within one edit; earlier is by id (null last),
    then by place.  A line also goes if that earlier line goes itself.  Blank lines
    always stay.  A null text has no lines and stays null; the empty text has one, blank.
    Rows that repeat id and text are one document and get one result.
    """
    rows = docs.select(column(docs, id_col).alias("id"), F.xxhash64(column(docs, text_col)).alias("th"), column(docs, text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    texts = rows.where("text is not null")
    lines = written(texts.mapInArrow(_lines(least), f"id {kind}, th long, no int, digest binary, keys array<long>"))
    first = F.struct(F.col("id").isNull().alias("last"), "id", "th", "no")
    distinct = stable(
        lines.where("digest is not null").groupBy("digest")
        .agg(F.min(first).alias("first"), F.first("keys").alias("keys")).drop("digest")
    )

    # Lines that agree with another line on all but one part, and in which parts.
    keyed = distinct.select("first", F.posexplode("keys").alias("part", "key"))
    shared = sized_broadcast(stable(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")))
    near = keyed.join(shared, "key").groupBy("first").agg(F.collect_set("part").alias("parts"))
    # Their texts: one row per document that holds such lines.
    wanted = near.groupBy(F.col("first.id").alias("_id"), F.col("first.th").alias("_th")).agg(
        F.collect_list(F.struct("first", "parts")).alias("near"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    found = (
        texts.join(sized_broadcast(stable(wanted), 20_000), same)
        .select(F.split("text", "\n", -1).alias("lines"), F.explode("near").alias("near"))
        .select("near.first", F.get("lines", F.col("near.first.no")).alias("line"), "near.parts")
    )
    found = written(found.dropDuplicates(["first"]))

    # Of every key the earliest line that is within one edit of a row of the given kind.
    of_first = f"struct<last:boolean,id:{kind},th:bigint,no:int>"
    variants = found.mapInArrow(_variants, f"key long, kind byte, first {of_first}")
    partner = {WHOLE: SHORTER, SHORTER: WHOLE, CHANGED: CHANGED}
    earliest = (
        variants.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.min(F.when(F.col("kind") == k, F.col("first"))).alias(f"best{k}") for k in partner])
        .where("n > 1").drop("n")
    )
    best = reduce(lambda out, k: F.when(F.col("kind") == k, F.col(f"best{partner[k]}")).otherwise(out), partner, F.lit(None))
    pairs = variants.join(earliest, "key").withColumn("best", best).where("best < first").select("first", "best").distinct()

    @F.pandas_udf("boolean")
    def near_enough(a, b):
        return type(a)([within_one_edit(x, y) for x, y in zip(a, b)], dtype=bool)

    checked = (
        pairs.join(found.select("first", "line"), "first")
        .join(found.select(F.col("first").alias("best"), F.col("line").alias("best_line")), "best")
        .where(near_enough("line", "best_line")).select("first").distinct()
    )
    stay = distinct.select("first").join(sized_broadcast(stable(checked)), "first", "left_anti").select("first.id", "first.th", "first.no")
    blank = lines.where("digest is null").select("id", "th", "no")
    kept = (
        stay.unionByName(blank.distinct()).groupBy(F.col("id").alias("_id"), F.col("th").alias("_th"))
        .agg(F.array_sort(F.collect_list("no")).alias("kept"))
    )
    whole = rows.join(kept, same, "left").withColumn("lines", F.split("text", "\n", -1))
    nothing = F.array().cast("array<int>")
    return whole.select(
        F.col("id").alias(id_col),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).alias("n_lines"),
        F.coalesce("kept", nothing).alias("kept"),
        F.when(F.col("text").isNotNull(), F.array_join(F.transform(F.coalesce("kept", nothing), lambda i: F.get("lines", i)), "\n")).alias(text_col),
    )
