"""Vector code compression: product quantisation over Hilbert-sorted flat blocks.

Vectors are cut into parts, and every part position has a codebook fitted by rounds of
integer k-means.  The parts of one position are sorted along a Hilbert curve and cut into
flat blocks, written once: a block stores its parts, their bounding box and their sums.
In every round a block's entries are first shortlisted by distances between the entries
and the box; an entry stays only if its least distance to the box is no more than the
smallest greatest distance of any entry, so that ties stay in.  A block with one entry
left is settled by its sums, copies among them; the others go through an exact integer
kernel over their shortlist.

Only codebooks (entries x components numbers) and their sums reach the driver.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causalog.llm.common import bounded_broadcast, column, stable, written
from causalog.llm.sharding import hilbert_index

#: Parts in a block.
BLOCK = 256

#: Hilbert cells per dimension are 2 ^ CELL_BITS, fewer where an index would pass 62 bits.
CELL_BITS = 3

#: Below this component a distance and its terms are exact in a double, too.
EXACT_IN_DOUBLE = 1 << 22


def usable(vector: F.Column) -> F.Column:
    """True for a vector that is not null and holds only finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def whole_numbers(vector: F.Column, scale: int) -> F.Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entries that can be nearest to some point of the box, ascending."""
    outside = np.maximum(np.maximum(low - book, book - high), 0)
    across = np.maximum(np.abs(book - low), np.abs(book - high))
    return np.flatnonzero((outside * outside).sum(1) <= (across * across).sum(1).min())


def nearest(parts: np.ndarray, book: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every part, ties to the lower entry; exact."""
    short = book[entries]
    most = max(np.abs(parts).max(initial=0), np.abs(short).max(initial=0))
    if most < EXACT_IN_DOUBLE and parts.shape[1] <= 128:
        x, c = parts.astype(np.float64), short.astype(np.float64)  # whole numbers below 2^53 throughout
        far = (c * c).sum(1) - 2 * (x @ c.T)
        at = far.argmin(1)
    else:
        far = np.stack([((parts - c) ** 2).sum(1) for c in short], 1)
        at = far.argmin(1)
    return entries[at], ((parts - short[at]) ** 2).sum(1)


def _rows(matrix: np.ndarray) -> pa.ListArray:
    n, size = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(matrix.reshape(-1), pa.int64()))


def _block(rows: pa.Table) -> pa.RecordBatch:
    x = _matrix(rows.column("x"))
    return pa.RecordBatch.from_arrays([
        pa.array([rows.column("part")[0].as_py()], pa.int32()), pa.array([len(x)], pa.int64()),
        *[_rows(m.reshape(1, -1)) for m in (x.min(0), x.max(0), x.sum(0), x, rows.column("key").to_numpy())],
    ], ["part", "n", "low", "high", "sums", "x", "keys"])


def _blocks(batches):
    """Sorted rows (part, curve, key, x) to blocks; a block has one part position."""
    held = None
    for batch in batches:
        held = pa.concat_tables([*([held] if held else []), pa.Table.from_batches([batch])])
        part = held.column("part").to_numpy()
        at, done = 0, []
        for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]:
            # The last run may go on in the next batch: only its whole blocks are cut.
            stop = end if end < len(part) else at + (end - at) // BLOCK * BLOCK
            done += [_block(held.slice(a, min(BLOCK, stop - a))) for a in range(at, stop, BLOCK)]
            at = stop
        held = held.slice(at)
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    if held:
        yield _block(held)


def _block_rows(batch: pa.RecordBatch):
    names = ("low", "high", "sums", "x", "keys")
    offsets = {c: batch.column(c).offsets.to_numpy() for c in names}
    values = {c: batch.column(c).values.to_numpy() for c in names}
    for i, (part, n) in enumerate(zip(batch.column("part").to_pylist(), batch.column("n").to_pylist())):
        row = {c: values[c][offsets[c][i]:offsets[c][i + 1]] for c in names}
        row["x"] = row["x"].reshape(n, -1)
        yield part, n, row


def _sums(shared):
    """Per task and entry: how many parts it got, and their sums."""
    def run(batches):
        books = shared.value
        parts, entries, size = books.shape
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for batch in batches:
            for part, n, row in _block_rows(batch):
                short = shortlist(row["low"], row["high"], books[part])
                if len(short) == 1:
                    count[part, short[0]] += n
                    total[part, short[0]] += row["sums"]
                    continue
                at, _ = nearest(row["x"], books[part], short)
                count[part] += np.bincount(at, minlength=entries)
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                total[part, at[order][first]] += np.add.reduceat(row["x"][order], first, 0)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), _rows(total[part, entry])],
            ["part", "entry", "n", "sums"])
    return run


def _codes(shared):
    def run(batches):
        books = shared.value
        for batch in batches:
            found = []
            for part, n, row in _block_rows(batch):
                at, far = nearest(row["x"], books[part], shortlist(row["low"], row["high"], books[part]))
                found.append((row["keys"], np.full(n, part, np.int32), at.astype(np.int32), far))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["key", "part", "entry", "far"])
    return run


def _new_books(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries become the floored means of their parts; unused ones stay."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    size = books.shape[2]
    found = blocks.mapInArrow(_sums(shared), "part int, entry int, n long, sums array<long>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(size)]).alias("sums"))
    out = books.copy()
    for r in found.collect():  # at most parts x entries rows
        out[r.part, r.entry] = [s // r.n for s in r.sums]
    shared.unpersist()
    return out


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, codes, errors) of every kept vector, and the codebooks (parts, entries, components).

    Components become floor(scale * x).  Rows whose vector is null or holds a null, NaN or
    infinity are dropped.  The first codebooks are the parts of the vectors with the smallest
    ids, null ids last, equal ids by their components; fewer vectors give fewer entries.
    ``codes`` and ``errors`` hold one number per part.  Repeated rows and ids each give a
    row; empty vectors are all alike; an empty table gives no rows and empty codebooks.
    Vectors of different lengths, lengths that do not divide into ``parts`` and components
    whose squared distances pass 64 bits are refused.
    """
    spark = vectors.sparkSession
    vector = column(vectors, vector_col)
    base = vectors.where(usable(vector)).select(
        column(vectors, id_col).alias("vec"), column(vectors, label_col).alias("label"), whole_numbers(vector, scale).alias("x"))
    least, most = base.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    schema = T.StructType([
        T.StructField(id_col, base.schema["vec"].dataType), T.StructField(label_col, base.schema["label"].dataType),
        T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("errors", T.ArrayType(T.LongType()))])
    if least is None:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    if least != most or most % parts:
        raise ValueError(f"vectors need one length that divides into {parts} parts, got {least} to {most}")
    reach = vectors.where(usable(vector)).agg(F.max(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double")))))).first()[0] or 0
    if reach * scale + 1 >= np.sqrt(2.0**61 / max(most, 1)):
        raise ValueError(f"components up to {reach} give distances beyond 64 bits")
    size = most // parts
    seeds = base.orderBy(F.col("vec").asc_nulls_last(), "x").limit(entries).select("x").collect()  # at most ``entries`` rows
    seeds = np.array([r.x for r in seeds], np.int64).reshape(len(seeds), parts, size)
    books = seeds.transpose(1, 0, 2).copy()
    if not size:
        nothing = F.array_repeat(F.lit(0), parts)
        return base.select(F.col("vec").alias(id_col), F.col("label").alias(label_col), nothing.alias("codes"), nothing.cast("array<long>").alias("errors")), books

    rows = written(base.withColumn("key", F.monotonically_increasing_id()))
    blocks = sorted_blocks(rows, books)
    for _ in range(rounds):
        books = _new_books(blocks, books)
    shared = spark.sparkContext.broadcast(books)
    coded = blocks.mapInArrow(_codes(shared), "key long, part int, entry int, far long").groupBy("key").agg(
        *[F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{c}{p}") for p in range(parts) for c in ("entry", "far")])
    return rows.select("key", "vec", "label").join(coded, "key").select(
        F.col("vec").alias(id_col), F.col("label").alias(label_col), F.array(*[f"entry{p}" for p in range(parts)]).alias("codes"), F.array(*[f"far{p}" for p in range(parts)]).alias("errors")), books


def sorted_blocks(rows: DataFrame, seeds: np.ndarray) -> DataFrame:
    """The parts of all ``rows`` (key, x) as flat blocks in Hilbert order, written once.

    Cells are cut at quantiles of the ``seeds``; those shape the order alone, no result.
    Rows of one cell are cut over tasks by their key.
    """
    parts, _, size = seeds.shape
    bits = max(1, min(CELL_BITS, 62 // size))
    dims = min(size, 62)  # longer parts are ordered by their first components
    cuts = np.quantile(seeds[:, :, :dims], np.arange(1, 1 << bits) / (1 << bits), axis=1)

    def curve(batches):
        for batch in batches:
            x = _matrix(batch.column("x")).reshape(batch.num_rows, parts, size)
            for p in range(parts):
                cells = (x[:, p, None, :dims] > cuts[None, :, p]).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), p, np.int32)), pa.array(hilbert_index(cells, bits)), batch.column("key"), _rows(x[:, p])],
                    ["part", "curve", "key", "x"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["part", "curve", "key"]
    flat = rows.select("key", "x").mapInArrow(curve, "part int, curve long, key long, x array<long>")
    schema = "part int, n long, low array<long>, high array<long>, sums array<long>, x array<long>, keys array<long>"
    return written(flat.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(_blocks, schema))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, label_col: str = "label", error_col: str = "error", name: str = "label_error") -> DataFrame:
    """``coded`` with the sum of ``error_col`` over rows of equal label, null labels together."""
    sums = stable(coded.groupBy(F.col(label_col).alias("_label")).agg(F.sum(error_col).alias(name)))
    return coded.join(bounded_broadcast(sums), F.col(label_col).eqNullSafe(F.col("_label")), "left").drop("_label")
