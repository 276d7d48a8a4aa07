"""Registered queries of this package and their SQL twins.

The queries are thin: they apply an operator with production parameters to its whole
table and derive digest columns from its result.
"""

from pyspark.sql import functions as F

from causalog.llm.common import stable, table, written
from causalog.llm.decontaminate import decontaminate
from causalog.llm.exact_dedup import exact_dedup
from causalog.llm import alignment, langid, quality, toxicity, vector_codes
from causalog.llm.line_dedup import dedup_lines
from causalog.llm.mixing import mix
from causalog.llm.reputation import filter_urls
from causalog.llm.sharding import hilbert_shards
from causalog.llm.simhash import near_duplicates
from causalog.llm.sql import SQL
from causalog.llm.warc import resolve_revisits


def _remainder(docs, parts):
    return F.crc32(docs["doc_id"].cast("string")) % parts


def page_records(pages):
    """Archive records as a crawl of ``pages`` makes them: every page's response, a
    conditional request ten seconds later and another after the crawl.

    The server confirms with the page's own ETag; every seventh page has none and is
    confirmed by date, every fifth has changed in between.
    """
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    has_tag, crlf = F.col("page_id") % 7 != 0, "\r\n"
    changed = F.when(F.col("page_id") % 5 == 0, F.lit("x")).otherwise("")
    modified = F.concat(F.lit("day "), (F.col("page_id") % 1000).cast("string"))

    def block(status, *fields):
        return F.concat_ws(crlf, F.lit(f"HTTP/1.1 {status}"), *fields)

    def field(name, value):
        return F.concat(F.lit(name + ": "), value)

    response = block(
        "200 OK", field("Content-Type", F.lit("text/html")), field("Content-Length", F.octet_length("html").cast("string")),
        F.when(has_tag, field("ETag", tag)), field("Last-Modified", modified), field("Cache-Control", F.lit("max-age=60")))
    confirmed = block(
        "304 Not Modified", F.when(has_tag, field("etag", F.concat(F.lit("W/"), changed, tag))),
        field("Last-Modified", F.concat(changed, modified)), field("Cache-Control", F.lit("max-age=600")), field("Content-Length", F.lit("0")))
    kinds = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(kind).alias("type"), F.lit(delay).alias("delay"), http.alias("http"))
        for k, kind, delay, http in ((0, "response", 0, response), (1, "revisit", 10, confirmed), (2, "revisit", 10**9, confirmed))])
    return pages.where("html is not null").select("page_id", "url", F.explode(kinds).alias("r")).select(
        (F.col("page_id") * 3 + F.col("r.k")).alias("record_id"), F.col("r.type").alias("type"), "url",
        F.timestamp_seconds(F.col("page_id") * 60 + F.col("r.delay")).alias("date"), F.col("r.http").alias("http"))


def op2_warc_revisits(spark, sf_dir):
    out = resolve_revisits(page_records(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform("headers", lambda x: F.concat(x["name"], F.lit(": "), x["value"])), "\n")
    return out.select("record_id", "url_key", "matched_id", "verdict", F.size("headers").cast("long").alias("n_headers"), F.md5(lines).alias("headers_md5"))


def op3_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def with_shape(docs):
    """Size in bytes plus one and checksum of a document, as the sharding queries define them."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def op6_sharding(spark, sf_dir):
    docs = with_shape(table(spark, sf_dir, "documents"))
    out = hilbert_shards(docs, ["size", "lang", "source"], 8, ties=[docs["text_crc32"], docs["doc_id"]], payload=["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_quality(docs, quality.train(docs), score_col="score")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("kept").cast("long").alias("n_kept"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_decontamination(spark, sf_dir):
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_remainder(docs, 3) == 1, F.lit(False))
    language = toxicity.language_model(docs)
    labelled = docs.where(~held_out).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    weights, bias = toxicity.train(labelled, language)
    scored = toxicity.score(docs.withColumn("held_out", held_out), language, weights, bias, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_remainder(docs, 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


#: Rules of the query, before reputation: (verdict, host/path).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op11_url_filters(spark, sf_dir):
    """The tables label no pages; a page takes the label of its number, bad if toxic or of poor quality."""
    labels = table(spark, sf_dir, "labels")
    bad = F.greatest(F.col("toxic"), 1 - F.col("quality"))
    return filter_urls(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), URL_RULES)


def op12_vector_codes(spark, sf_dir):
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    error = F.aggregate("errors", F.lit(0).cast("long"), lambda a, b: a + b)
    found = stable(coded.select("vec_id", "label", code.alias("code"), error.alias("error")))
    return vector_codes.with_label_error(found).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_alignment(spark, sf_dir):
    aligned = alignment.align_tokens(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = written(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return alignment.with_link_counts(rows, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])


SPARK = {f.__name__: f for f in (op1_toxicity, op2_warc_revisits, op3_simhash, op4_mixing, op5_exact_dedup, op6_sharding, op7_language, op8_quality, op9_line_dedup, op10_decontamination, op11_url_filters, op12_vector_codes, op13_alignment)}

__all__ = ["SPARK", "SQL"]
