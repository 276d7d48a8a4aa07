import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalog.llm.registry import URL_RULES
from causalog.llm.reputation import STRONGEST, WEAKEST, filter_urls, host_reputation, normal_score, registered, rule_for, url_parts

PAGES, LABELS = "page_id long, url string", "page_id long, bad int"


def test_url_parts(spark):
    cases = {
        "http://A.Example.NET/en/x?q=/a#b": ("a.example.net", "/en/x"), "https://h": ("h", ""), "x://": ("", ""), "no scheme/a": ("", ""),
        None: ("", ""), "": ("", ""), "a://b?c://d": ("b", ""), "http://u:P@Host:80/p://q": ("u:p@host:80", "/p://q"),
        "http://É.de/Ä": ("É.de", "/Ä"), "s://a\nb/c\nd#e": ("a\nb", "/c\nd"), "s://h#/en/": ("h", ""),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r[0]: (r[1], r[2]) for r in df.select("url", *url_parts(F.col("url"))).collect()}
    assert got == cases


def test_registered(spark):
    cases = {
        "a.b.example.com": ("example.com", "com"), "example.com:80": ("example.com", "com"), "x.shop.co.uk": ("shop.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk"), "com": ("com", "com"), "": ("", ""), "u@10.0.0.1:8": ("10.0.0.1", "10.0.0.1"), "a.example.org.": ("example.org", "org"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "host string")
    assert {r[0]: (r[1], r[2]) for r in df.select("host", *registered(F.col("host"))).collect()} == cases


def brute_rule(host, path, rules):
    fit = [(len(t), len(t.split("/")[0]), -i, t, v) for i, (v, t) in enumerate(rules)
           if ("." + host).endswith("." + t.split("/")[0]) and path.startswith(t[t.index("/"):])]
    return max(fit)[3:] if fit else (None, None)


def test_longest_rule_wins(spark):
    rules = [*URL_RULES, ("allow", "a.net/x"), ("block", "a.net/x"), ("block", "b.a.net/"), ("allow", "net/xxxx/")]
    urls = [(h, p) for h in ("net", "a.net", "b.a.net", "ba.net", "example.net", "m.example.net", "example.com", "q.org", "", "netx") for p in ("", "/", "/en/", "/en", "/de/1", "/fr/", "/x", "/xxxx/y")]
    df = spark.createDataFrame(urls, "host string, path string")
    got = df.select("host", "path", *rule_for(F.col("host"), F.col("path"), rules)).collect()
    assert all((r[2], r[3]) == brute_rule(r[0], r[1], rules) for r in got)


def model(hosts, first=0.1):
    """The shrinkage in plain Python: {host: (n, bad)} to {host: (a, b)}."""
    def strength(children):
        over = sum((k - n * mu) ** 2 - n * mu * (1 - mu) for n, k, mu in children)
        pairs = sum(n * (n - 1) * mu * (1 - mu) for n, k, mu in children)
        rho = over / pairs if pairs else 0
        return min(max(1 / rho - 1, WEAKEST), STRONGEST) if rho > 0 else STRONGEST

    def summed(rows, cut):
        out = {}
        for name, (n, k) in rows.items():
            a, b = out.get(cut(name), (0, 0))
            out[cut(name)] = (a + n, b + k)
        return out

    domains = summed(hosts, lambda h: ".".join(h.split(".")[-2:]))
    suffixes = summed(domains, lambda d: d.split(".")[-1])
    n, k = map(sum, zip(*hosts.values()))
    mu = (first + k) / (1 + n)
    means = {"": mu}
    for rows, up in ((suffixes, lambda s: ""), (domains, lambda d: d.split(".")[-1])):
        m = strength([(n, k, means[up(x)]) for x, (n, k) in rows.items()])
        means = {x: (m * means[up(x)] + k) / (m + n) for x, (n, k) in rows.items()}
    own = {h: means[".".join(h.split(".")[-2:])] for h in hosts}
    m = strength([(n, k, own[h]) for h, (n, k) in hosts.items()])
    return {h: (m * own[h] + k, m * (1 - own[h]) + n - k) for h, (n, k) in hosts.items()}


def test_posteriors_against_a_model(spark):
    rng = np.random.default_rng(3)
    hosts = {f"h{i}.d{i % 5}.{'com' if i % 5 < 3 else 'org'}": (int(n), int(rng.binomial(n, 0.9 if i % 7 == 0 else 0.1))) for i, n in enumerate(rng.integers(0, 60, 40))}
    labels = [(h, int(i < k)) for h, (n, k) in hosts.items() for i in range(n)]
    outcomes = spark.createDataFrame([*labels, ("x.d0.com", None)], "host string, bad int")
    pages = spark.createDataFrame([(h,) for h in hosts] * 2, "host string")
    got = host_reputation(pages, outcomes).collect()
    want = model(hosts)
    assert len(got) == len(hosts) and all(math.isclose(r.a, want[r.host][0], rel_tol=1e-9) and math.isclose(r.b, want[r.host][1], rel_tol=1e-9) for r in got)
    assert {r.host for r in got if r.blocked} and not any(r.blocked for r in got if r.n > 20 and r.bad / r.n < 0.2)


@pytest.mark.parametrize("a,b", [(1.0, 6.0), (0.4, 4.0), (3.0, 3.0), (40.0, 110.0), (12.0, 2.5), (900.0, 2000.0)])
def test_normal_score_is_near_the_beta_distribution(spark, a, b):
    y = spark.range(1).select(normal_score(F.lit(a), F.lit(b), 0.3)).first()[0]
    u = (np.arange(2_000_000) + 0.5) / 2_000_000
    density = np.exp((a - 1) * np.log(u) + (b - 1) * np.log1p(-u) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
    true = density[u <= 0.3].sum() / density.sum()
    assert abs(0.5 * (1 + math.erf(y / math.sqrt(2))) - true) < 0.006


def test_a_bad_host_is_blocked_and_rules_come_first(spark):
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}.site.com/p/{i}") for i in range(200)]
    pages += [(1001, "http://bad.site.com/de/x"), (None, "http://bad.site.com"), (1, "http://bad.site.com/again"), (1002, None), (1003, ""), (1004, "http://bad.site.net/" + "y" * 100_000)]
    labels = [(i, int(i % 2)) for i in range(200)] + [(1, 0), (2, None), (None, 1), (77777, 1)]
    p = spark.createDataFrame(pages, PAGES).withColumns({c: F.lit("z") for c in ("id", "host", "path", "bad", "rule", "n", "a", "b", "by_host")})
    out = filter_urls(p, spark.createDataFrame(labels, LABELS), [*URL_RULES, ("allow", "site.com/de/")]).collect()
    assert sorted((r.page_id is None, r.page_id or 0) for r in out) == sorted((i is None, i or 0) for i, _ in pages)
    by = {(r.page_id, r.path): (r.rule, r.verdict) for r in out}
    assert by[(1, "/p/1")] == by[(1, "/again")] == by[(None, "")] == (None, "block") and by[(2, "/p/2")] == (None, "allow")
    assert by[(1001, "/de/x")] == ("site.com/de/", "allow") and by[(1002, "")] == by[(1003, "")] == (None, "allow")
    assert by[(1004, "/" + "y" * 100_000)] == ("net/", "block")


def test_empty_tables_and_no_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_urls(spark.createDataFrame([], PAGES), none, URL_RULES).count() == 0
    out = filter_urls(spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x")], PAGES), none)
    assert [(r.rule, r.verdict) for r in out.collect()] == [(None, "allow")] * 2
