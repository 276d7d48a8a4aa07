import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from causalog.llm.warc import PERMITTED, canonical_url, resolve_revisits

RECORDS = "record_id long, type string, url string, date timestamp, http string"


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def block(status, **fields):
    return "\r\n".join([f"HTTP/1.1 {status} X", *[f"{k.replace('_', '-')}: {v}" for k, v in fields.items()], "", ""])


@pytest.mark.parametrize("url,key", [
    ("http://www.Example.com:80/A/b/?b=2&utm_source=x&a=1#top", "example.com/A/b?a=1&b=2"),
    ("HTTPS://example.com", "example.com"), ("https://example.com/", "example.com"), ("example.com/x?", "example.com/x"),
    ("http://example.com?q=http://other/", "example.com?q=http://other/"), ("https://example.com:8080/p#a?b", "example.com:8080/p"), (None, None), ("", ""),
])
def test_canonical_url(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(canonical_url(F.col("u")).alias("k")).first().k == key


def resolve(spark, records):
    got = resolve_revisits(spark.createDataFrame(records, RECORDS)).collect()
    return {r.record_id: (r.matched_id, r.verdict, None if r.headers is None else [tuple(h) for h in r.headers]) for r in got}


def test_validators_and_headers(spark):
    u = "http://a.example/p"
    got = resolve(spark, [
        (1, "response", u, at(0), block(200, ETag='"v1"', Content_Type="text/html", Cache_Control="max-age=1", Set_Cookie="a")),
        (2, "response", u, at(20), block(200, ETag='W/"v2"', Last_Modified="d2", Content_Type="text/plain")),
        (3, "response", u, at(25), block(404, ETag='"v3"')), (4, "response", u, at(26), block(206, ETag='"v4"')),
        (10, "revisit", "https://www.a.example/p/#x", at(10), block(304, etag='W/"v1"', cache_control="max-age=9", Content_Length="0", Set_Cookie="b")),
        (11, "revisit", u, at(30), block(304, ETag='"v2"')), (12, "revisit", u, at(30), block(304, ETag='"v1"')),
        (13, "revisit", u, at(30), block(304, Last_Modified="d2", Expires="soon")), (14, "revisit", u, at(30), block(304)),
        (15, "revisit", u, at(30), block(304, Last_Modified="d1")), (16, "revisit", u, at(0), block(304, ETag='"v1"')),
        (17, "revisit", "http://b.example/", at(30), block(304)), (18, "revisit", None, at(30), block(304)), (19, "revisit", u, None, block(304)),
        (20, "revisit", u, at(30), block(200)), (21, "revisit", u, at(30), None), (22, None, u, at(30), block(304)), (23, "request", u, at(30), block(304)),
    ])
    assert got[10] == (1, "matched", [("cache-control", "max-age=9"), ("content-type", "text/html"), ("etag", 'W/"v1"'), ("set-cookie", "a")])
    assert got[11][:2] == (2, "matched") and got[12] == (None, "mismatch", None)
    assert got[13] == (2, "matched", [("content-type", "text/plain"), ("etag", 'W/"v2"'), ("expires", "soon"), ("last-modified", "d2")])
    assert got[14][:2] == (2, "unverified") and got[15][1] == "mismatch"
    assert all(got[i] == (None, "missing", None) for i in (16, 17, 18, 19))
    assert set(got) == set(range(10, 20))


def test_against_brute_force_with_one_hot_url(spark):
    rng = random.Random(2)
    records = []
    for i in range(600):
        url = "http://hot.example/" if rng.random() < 0.5 else f"http://h{rng.randrange(30)}.example/"
        tag = rng.choice(["a", "b", None])
        fields = {"ETag": tag, "Vary": str(i)} if tag else {"Vary": str(i)}
        kind, status = rng.choice([("response", 200), ("revisit", 304), ("response", 500)])
        records.append((i, kind, url, at(rng.randrange(200)), block(status, **fields)))
    want = {}
    for i, kind, url, when, http in records:
        if kind != "revisit":
            continue
        before = [r for r in records if r[1] == "response" and " 200 " in r[4] and r[2] == url and r[3] < when]
        if not before:
            want[i] = (None, "missing")
            continue
        last = max(before, key=lambda r: (r[3], r[0]))
        tags = [next((x.split(": ")[1] for x in b.split("\r\n") if x.startswith("ETag")), None) for b in (last[4], http)]
        verdict = "unverified" if None in tags else "matched" if tags[0] == tags[1] else "mismatch"
        want[i] = (last[0] if verdict != "mismatch" else None, verdict)
    got = resolve(spark, records + records[:5])
    assert {k: v[:2] for k, v in got.items()} == want


def test_empty_table_and_clashing_columns(spark):
    assert resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0
    extra = spark.createDataFrame([(1, "revisit", "http://a/", at(1), block(304))], RECORDS)
    extra = extra.withColumns({c: F.lit(c) for c in ("id", "url_key", "headers", "verdict", "stored", "rank", "full", "revisit", "__range")})
    assert resolve_revisits(extra).first().verdict == "missing"
    assert "etag" in PERMITTED
