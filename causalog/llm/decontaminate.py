"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of ``window`` words (a shorter item is one window).  A
window is contained in a document exactly if all its shingles are, so its rarest
shingle alone must be there: that one-shingle prefix is joined with the documents'
shingles.  The position of the match fixes where the window would lie; it must lie
inside the document, and then the words themselves are compared.

DataFrame operations only.  Texts are read by scans; of them only the documents with a
candidate are shuffled.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalog.llm.common import column, letters_lower, sized_broadcast, stable

#: After lower-casing A-Z, words are runs of a-z, 0-9 and everything beyond ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Row hashes (one long each) sent to every executor to pick candidate documents.
ID_ROWS = 2_000_000


def words(text: Column) -> Column:
    found = F.regexp_extract_all(letters_lower(text), F.lit(ITEM_WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _shingles(words: Column, n: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, null where there are none."""
    hashed = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))
    return F.when(n >= size, hashed)


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(wtext, len, items): every distinct window and the sorted ids, as text, of its items."""
    items = benchmark.select(column(benchmark, id_col).cast("string").alias("item"), words(column(benchmark, text_col)).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("n", F.size("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - window))
    cut = items.select("item", F.least("n", F.lit(window)).alias("len"), "words", F.explode(starts).alias("at"))
    return (
        cut.select("item", "len", F.array_join(F.slice("words", F.col("at") + 1, F.col("len")), " ").alias("wtext"))
        .groupBy("wtext", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def occurrences(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(row, pos, size, h): where a shingle of any window stands in a document."""
    read = docs.select("row", words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    small = sized_broadcast(shingles)
    return reduce(DataFrame.unionByName, [
        read.select("row", F.posexplode(_shingles(F.col("words"), F.col("n"), size)).alias("pos", "h"))
        .join(small.where(F.col("size") == size).select("h"), "h", "left_semi")
        .select("row", "pos", F.lit(size).alias("size"), "h")
        for size in sizes
    ])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3,
) -> DataFrame:
    """One row per input row: id, n_words, n_hit, spans, items, contaminated.

    ``spans`` are the starts and lengths (in words) of the windows found, ``items`` the
    sorted ids as text; a word counts once in ``n_hit`` however many windows cover it.
    Null and empty texts have no words; an item without words has no window; an empty
    benchmark contaminates nothing and an empty table gives no rows.  Rows that repeat an
    id, null ids too, are each checked on their own text: candidates are gathered by a
    hash of id and text, so no id holds more than the windows of one text.
    """
    docs = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text"))
    docs = docs.withColumn("row", F.xxhash64("id", "text"))
    windows = stable(item_windows(benchmark, item_col, item_text_col, window))
    ranked = windows.withColumn("w", F.split("wtext", " "))
    sizes = sorted(r["size"] for r in ranked.select(F.least("len", F.lit(shingle)).alias("size")).distinct().collect())
    none = F.array().cast("array<struct<start:int,len:int>>"), F.array().cast("array<string>")
    clean = (F.lit(0).cast("long").alias("n_hit"), none[0].alias("spans"), none[1].alias("items"))
    n_words = F.coalesce(F.regexp_count("text", F.lit(_RAW_WORD)), F.lit(0)).cast("long").alias("n_words")
    if not sizes:
        out = docs.select("id", n_words, *clean)
        return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "spans", "items", F.lit(False).alias("contaminated"))

    parts = [
        ranked.where(F.least("len", F.lit(shingle)) == size)
        .select("wtext", "len", "items", F.lit(size).alias("size"), F.posexplode(_shingles(F.col("w"), F.col("len"), size)).alias("offset", "h"))
        for size in sizes
    ]
    parts = stable(reduce(DataFrame.unionByName, parts))
    found = stable(occurrences(docs, parts.select("size", "h").distinct(), sizes))

    # Rarity over all documents; a window with a shingle that never occurs is out.
    rarity = found.groupBy("size", "h").agg(F.count(F.lit(1)).alias("rows"))
    prefix = (
        parts.join(sized_broadcast(stable(rarity)), ["size", "h"], "left")
        .groupBy("wtext", "len", "size")
        .agg(F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "h", "offset")).alias("rare"), F.first("items").alias("items"))
        .where("rare.rows > 0")
        .select("wtext", "len", "size", "items", "rare.h", "rare.offset")
    )
    hits = (
        found.join(sized_broadcast(stable(prefix)), ["size", "h"])
        .withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
        .groupBy("row").agg(F.collect_set(F.struct("start", "len", "wtext", "items")).alias("hits"))
    )
    hits = stable(hits)
    candidates = sized_broadcast(hits.select("row"), ID_ROWS)
    tried = (
        docs.join(candidates, "row", "left_semi").select("id", "row", words(F.col("text")).alias("words"))
        .withColumn("n_words", F.size("words").cast("long"))
        .join(hits, "row")
    )
    there = tried.select(
        "id", "n_words",
        F.filter("hits", lambda x: (x["start"] + x["len"] <= F.col("n_words"))
                 & (F.array_join(F.slice("words", x["start"] + 1, x["len"]), " ") == x["wtext"])).alias("hits"),
    ).withColumn("places", F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))))
    there = there.select(
        "id", "n_words", F.size("places").cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"])))).alias("items"),
    )
    rest = docs.join(candidates, "row", "left_anti").select("id", n_words, *clean)
    return there.unionByName(rest).select(
        F.col("id").alias(id_col), "n_words", "n_hit", "spans", "items", (F.col("n_hit") > 0).alias("contaminated"))
