"""Not-modified revisits of a web archive, resolved to the response they confirm.

A revisit record with status 304 has headers but no body.  It stands for the latest
earlier full response of its canonical URL, if the validators agree; the resolved
record has that response's headers with the permitted ones taken from the revisit
(RFC 9110 15.4.5, RFC 9111 4.3.4).

The as-of join is a scan along (URL, date) in range partitions with a carried last value
per URL and range, so a URL with very many captures is cut over many tasks.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalog.llm.common import column
from causalog.plans.scan import Running, prefix_scan, sorted_buckets

# What a 304 may update in a stored response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
_HEADER = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a trailing slash, query
    without tracking parameters and in order; scheme and fragment left out.  Null stays null."""
    text = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(text, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www[0-9]*\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^utm_")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def http_status(block: Column) -> Column:
    return F.regexp_extract(block, "^HTTP/[0-9.]+ ([0-9]{3})", 1)


def http_headers(block: Column) -> Column:
    """Header fields of a block as (name in lower case, value), in order; lines without a colon are left out."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: x.rlike("^[^\\s:]+:"))
    fields = F.transform(lines, lambda x: F.struct(
        F.lower(F.regexp_extract(x, "^([^:]+):", 1)).alias("name"), F.trim(F.regexp_extract(x, ":(.*)$", 1)).alias("value")))
    return F.coalesce(fields, F.array().cast(_HEADER))


def header(fields: Column, name: str) -> Column:
    """The first value of a field, null if there is none."""
    return F.get(F.filter(fields, lambda x: x["name"] == name), F.lit(0))["value"]


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored fields with every permitted field that the update has taken from there; by name."""
    new = F.filter(update, lambda x: x["name"].isin(*PERMITTED))
    names = F.transform(new, lambda x: x["name"])
    old = F.filter(stored, lambda x: ~F.array_contains(names, x["name"]))
    return F.array_sort(F.concat(old, new))


def resolve_revisits(
    records: DataFrame, id_col: str = "record_id", type_col: str = "type", url_col: str = "url",
    date_col: str = "date", http_col: str = "http",
) -> DataFrame:
    """One row per not-modified revisit: id, url_key, date, matched_id, verdict, headers.

    Input are records with an HTTP header block.  A full response is a dated response
    with status 200; the latest one strictly earlier is taken, of several at one instant
    the greatest id.  Verdicts: ``matched`` (ETags agree, weak or strong, or without two
    ETags the Last-Modified dates), ``unverified`` (no validator on both sides; taken as a
    match), ``mismatch`` and ``missing`` (no earlier response, no URL or no date); the
    last two have no headers and no matched_id.  Other records, null types and blocks
    without a status among them, give no rows; repeated revisits each give one.
    """
    block = column(records, http_col)
    fields = http_headers(block)
    is_revisit = (column(records, type_col) == "revisit") & (http_status(block) == "304")
    is_full = (column(records, type_col) == "response") & (http_status(block) == "200")
    seen = records.select(
        column(records, id_col).alias("id"), canonical_url(column(records, url_col)).alias("url_key"),
        column(records, date_col).alias("date"), fields.alias("headers"), is_revisit.alias("revisit"), is_full.alias("full"),
    ).where(F.col("revisit") | F.col("full"))
    placed = seen.where("url_key is not null and date is not null").withColumn("rank", F.col("full").cast("int"))
    # A revisit stands before the responses of its instant.
    order = ["date", "rank", "id"]
    ranged = sorted_buckets(placed, ["url_key", *order])
    last = Running("last", F.when(F.col("full"), F.struct("id", "headers")), inclusive=False)
    joined = prefix_scan(ranged, ["url_key"], order, F.col("__range"), {"stored": last}, levels=2).where("revisit")

    def etag(fields: Column) -> Column:
        return F.regexp_replace(header(fields, "etag"), "^W/", "")

    old, new = F.col("stored.headers"), F.col("headers")
    agree = F.coalesce(etag(old) == etag(new), header(old, "last-modified") == header(new, "last-modified"))
    verdict = (
        F.when(F.col("stored").isNull(), "missing").when(agree.isNull(), "unverified")
        .when(agree, "matched").otherwise("mismatch")
    )
    found = joined.withColumn("verdict", verdict).select(
        "id", "url_key", "date", "verdict",
        F.when(F.col("verdict").isin("matched", "unverified"), F.col("stored.id")).alias("matched_id"),
        F.when(F.col("verdict").isin("matched", "unverified"), merged_headers(old, new)).alias("headers"),
    )
    nowhere = seen.where("revisit and (url_key is null or date is null)").select(
        "id", "url_key", "date", F.lit("missing").alias("verdict"), F.lit(None).cast(seen.schema["id"].dataType).alias("matched_id"),
        F.lit(None).cast(_HEADER).alias("headers"))
    return found.unionByName(nowhere).select(F.col("id").alias(id_col), "url_key", "date", "matched_id", "verdict", "headers")
