"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that of two fingerprints within the
distance some segment differs by at most one bit (three segments for distance 4).
Each segment is indexed once per bit with that bit left out; fingerprints that link
share such a key, are joined on it and verified.

Only distinct fingerprints are indexed.  A key that more than ``bucket`` of them share
is not joined with itself: its fingerprints go by midpoints instead.  Two fingerprints
are within 2 r bits exactly if some value is within r bits of both, so linking each
value's fingerprints to the least of them gives the same components, without pairs.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalog.llm.common import column, sized_broadcast, stable, text_bytes
from causalog.llm.components import components

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = (np.arange(8) * 256)[None, :]
#: Keys hold the segment (at most 32 bits wide from distance 2 on) below the bit number.
_SHIFT = 32


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash of a UTF-8 text as a signed number; 0 for a text without words."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        digests = [xxhash.xxh64_digest(line, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends[:-shingle].tolist())
        starts.insert(0, 0)
        digest = xxhash.xxh64_digest
        digests = [digest(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    own = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    counts = np.bincount((own + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (2 * counts.ravel() > len(own)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) per input row; null and empty texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            raw = data.data
            fps = [fingerprint(bytes(raw[at[i]:at[i + 1]]), shingle) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    narrow = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, fp long")


def segments(distance: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit."""
    n = distance // 2 + 1  # with n segments of two or more differences each, 2 n > distance
    edges = [round(i * bits / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variant_keys(fp: Column, distance: int) -> Column:
    """The one-wildcard keys of a fingerprint: per bit, the bit's number over its segment without that bit."""
    keys = []
    for first, width in segments(distance):
        part = F.shiftrightunsigned(fp, first).bitwiseAND((1 << width) - 1)
        keys += [part.bitwiseAND(((1 << width) - 1) ^ (1 << j)) + ((first + j) << _SHIFT) for j in range(width)]
    return F.array(*keys)


def first_shared(a: Column, b: Column, distance: int) -> Column:
    """Bit number of the first key that two fingerprints share, -1 if none: each pair counts once."""
    diff = a.bitwiseXOR(b)
    out = F.lit(-1)
    for first, width in reversed(segments(distance)):
        part = F.shiftrightunsigned(diff, first).bitwiseAND((1 << width) - 1)
        lone = F.bit_count(part - 1) + first  # a single set bit, as a number
        out = F.when(part == 0, F.lit(first)).when(F.bit_count(part) == 1, lone).otherwise(out)
    return out


def _flips(fp: Column, most: int) -> Column:
    """All values within ``most`` bits of a fingerprint."""
    masks = [0]
    for r in range(1, most + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(64), r)]
    signed = np.array(masks, np.uint64).astype(np.int64).tolist()
    return F.transform(F.lit(signed), lambda m: fp.bitwiseXOR(m))


def links(fps: DataFrame, distance: int = 4, bucket: int = 256) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fps(fp)`` whose components are those of
    all pairs within ``distance``.

    In keys of at most ``bucket`` fingerprints every pair is listed once.  Fingerprints of
    fuller keys are linked through midpoints, an exact way for an even distance.
    """
    if distance % 2 or distance < 2:
        raise ValueError("an even distance from 2 on is needed")
    keyed = fps.select("fp", F.explode(variant_keys(F.col("fp"), distance)).alias("key"))
    full = stable(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key"))
    crowded = None
    if not full.isEmpty():
        full = sized_broadcast(full)
        crowded = stable(keyed.join(full, "key", "left_semi").select("fp").distinct())
        keyed = keyed.join(full, "key", "left_anti")
    a, b = keyed.select("key", F.col("fp").alias("a")), keyed.select(F.col("key").alias("key_b"), F.col("fp").alias("b"))
    pairs = a.join(
        b,
        (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b"))
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        & (first_shared(F.col("a"), F.col("b"), distance) == F.shiftright("key", _SHIFT)),
    ).select("a", "b")
    if crowded is None:
        return pairs
    near = crowded.select("fp", F.explode(_flips(F.col("fp"), distance // 2)).alias("mid"))
    least = near.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("mid", "a")
    return pairs.unionByName(near.join(least, "mid").where("a < fp").select("a", F.col("fp").alias("b")).distinct())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, bucket: int = 256,
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest id reachable over links of at most ``distance``
    differing bits, the row's own included (null ids count as largest).  Texts without
    words, null ones too, have fingerprint 0 and link like any other; an empty table
    gives no rows; other columns are not read.
    """
    fps = stable(fingerprints(docs, id_col, text_col, shingle))
    distinct = stable(fps.groupBy("fp").agg(F.min("id").alias("least")))
    parts = stable(components(links(distinct.select("fp"), distance, bucket)).withColumnRenamed("node", "fp"))
    linked = distinct.join(parts, "fp")
    smallest = sized_broadcast(stable(linked.groupBy("root").agg(F.min("least").alias("component_id"))))
    named = linked.join(smallest, "root").select("fp", "component_id")
    # Written, so that the join with all rows has plain exchanges, which split where one fingerprint is very common.
    classes = sized_broadcast(stable(
        distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))))
    return fps.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
