"""URL filters: host reputation by empirical Bayes, behind rules set by hand.

Labelled page outcomes are counted per host.  The rate of bad pages is shrunk downwards
through beta-binomial priors: all pages -> suffix -> registered domain -> host.  Every
step's prior has the mean of its parent and a strength estimated from how much the
children differ beyond chance (moments of the beta-binomial).  A host is blocked when its
posterior puts at least ``confidence`` on a rate above ``limit``.

Counts are combined on the map side before they are shuffled, so a host with a third of
all pages costs no more than others; pages meet only the blocked hosts.
"""

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalog.llm.common import bounded_broadcast, column, letters_lower, stable

#: Suffixes of two labels under which domains are registered.  Others have one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.jp", "ne.jp", "com.br", "co.in", "co.kr", "com.cn", "co.za", "co.nz")

#: Range of a prior's strength, in pages.
WEAKEST, STRONGEST = 4.0, 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased, port and user part as written) and path; both empty without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, url.substr(start + 3, F.char_length(url))).otherwise("")
    host, path = F.regexp_extract(rest, "^[^/?#]*", 0), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return letters_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def registered(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix.  A numeric address is its own domain and suffix."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "\\.+$", "")
    last = F.substring_index(name, ".", -1)
    suffix = F.when(F.substring_index(name, ".", -2).isin(*two_label), F.substring_index(name, ".", -2)).otherwise(last)
    domain = F.when(suffix == last, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -3))
    numeric = name.rlike("^[0-9.]+$") | name.startswith("[")
    return F.when(numeric, name).otherwise(domain), F.when(numeric, name).otherwise(suffix)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one.

    ``rules`` is a short list, set by hand, of (verdict, ``host/path``).  A rule fits its
    host and all subdomains when the path starts with the rule's.  Of two equally long
    rules the one with the longer host wins, then the earlier one.
    """
    def cut(rule):
        return rule[:rule.index("/")], rule[rule.index("/"):]

    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The best rule stands first in the expression, so it is added last.
    for kind, text in sorted(reversed(rules), key=lambda r: (len(r[1]), len(cut(r[1])[0]))):
        own, below = cut(text)
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(below)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def strength(children: DataFrame) -> float:
    """Strength of the prior the children (n, bad, mu) share: how little they differ beyond chance.

    Moments: sum (bad - n mu)^2 = sum n mu (1 - mu) (1 + (n - 1) rho), rho = 1 / (1 + strength).
    Without two labelled pages in any child nothing shows a difference: the strongest.
    """
    spread = F.col("mu") * (1 - F.col("mu"))
    over, pairs = children.agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("mu"), F.lit(2)) - F.col("n") * spread),
        F.sum(F.col("n") * (F.col("n") - 1) * spread),
    ).first()
    rho = over / pairs if pairs else 0.0
    return min(max(1 / rho - 1, WEAKEST), STRONGEST) if rho > 0 else STRONGEST


def _posterior(children: DataFrame, m: float) -> Column:
    return (m * F.col("mu") + F.col("bad")) / (m + F.col("n"))


def host_reputation(
    pages: DataFrame, outcomes: DataFrame, host_col: str = "host", bad_col: str = "bad",
    first_rate: float = 0.1, limit: float = 0.3, confidence: float = 0.9,
    two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """One row per host: host, domain, suffix, n, bad, a, b, rate, blocked.

    ``outcomes`` are labelled pages (host, 0 or 1; null labels are left out); ``pages``
    name the hosts to judge, labelled or not.  The posterior is Beta(a, b), ``rate`` its
    mean.  Without any label the rate starts from ``first_rate``.  A null host counts as
    the empty host, which is its own domain and suffix.
    """
    def counted(df, n, bad):
        return df.select(F.coalesce(column(df, host_col), F.lit("")).alias("host"), n.alias("n"), bad.alias("bad"))

    known = outcomes.where(column(outcomes, bad_col).isNotNull())
    rows = counted(pages, F.lit(0).cast("long"), F.lit(0).cast("long")).unionByName(
        counted(known, F.lit(1).cast("long"), column(known, bad_col).cast("long")))
    domain, suffix = registered(F.col("host"), two_label)
    hosts = stable(
        rows.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        .select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"))
    domains = stable(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = stable(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))

    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = (first_rate + (total.bad or 0)) / (1 + (total.n or 0))
    suffixes = suffixes.withColumn("mu", F.lit(overall))
    suffixes = suffixes.select("suffix", _posterior(suffixes, strength(suffixes)).alias("mu"))
    domains = stable(domains.join(bounded_broadcast(stable(suffixes)), "suffix"))
    domains = domains.select("domain", "suffix", _posterior(domains, strength(domains)).alias("mu"))
    hosts = stable(hosts.join(bounded_broadcast(stable(domains)), ["domain", "suffix"]))
    m = strength(hosts)
    return hosts.withColumns({"a": m * F.col("mu") + F.col("bad"), "b": m * (1 - F.col("mu")) + F.col("n") - F.col("bad")}).select(
        "host", "domain", "suffix", "n", "bad", "a", "b", (F.col("a") / (F.col("a") + F.col("b"))).alias("rate"),
        (normal_score(F.col("a"), F.col("b"), limit) <= -NormalDist().inv_cdf(confidence)).alias("blocked"))


def normal_score(a: Column, b: Column, x: float) -> Column:
    """y with P(Beta(a, b) <= x) close to the normal distribution's value at y (Abramowitz and Stegun 26.5.21)."""
    third = F.lit(1 / 3)
    low, high = F.pow(b * x, third), F.pow(a * (1 - x), third)
    return 3 * (low * (1 - 1 / (9 * b)) - high * (1 - 1 / (9 * a))) / F.sqrt(low * low / b + high * high / a)


def filter_urls(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = (), id_col: str = "page_id",
    url_col: str = "url", label_id_col: str = "page_id", bad_col: str = "bad", **options,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict (``allow`` or ``block``).

    ``labels`` (id, 0 or 1) marks some pages as bad; a page with several labels is bad if
    one says so.  Rows that repeat an id each count and are each judged; null ids have no
    label.  A null url, or one without ``://``, has the empty host and path.  A rule
    decides before reputation.  Empty tables give no rows; without labels all hosts are allowed.
    """
    host, path = url_parts(column(pages, url_col))
    rows = pages.select(column(pages, id_col).alias("id"), host.alias("host"), path.alias("path"))
    marked = labels.select(column(labels, label_id_col).alias("id"), column(labels, bad_col).cast("long").alias("bad"))
    marked = marked.where("id is not null and bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    found = host_reputation(rows, rows.select("id", "host").join(marked, "id"), **options)
    blocked = bounded_broadcast(stable(found.where("blocked").select("host", F.lit("block").alias("by_host"))))
    rule, verdict = rule_for(F.col("host"), F.col("path"), list(rules))
    return rows.join(blocked, "host", "left").select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.col("by_host"), F.lit("allow")).alias("verdict"))
