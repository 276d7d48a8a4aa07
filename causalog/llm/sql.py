"""SQL twins of the registered document queries, for DuckDB on the same tables."""

#: ASCII white space and its complement, as regular expressions.
_WHITE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _overlap(k: int) -> str:
    return f"greatest(0, least(start + length, x + {k} * tokens + size) - greatest(start, x + {k} * tokens))"


def _seats(name: str, parties: str, within: str, key: str, votes: str, seats: str, most: str) -> str:
    """Sainte-Lague: the highest quotients among those that can win a seat."""
    return f"""
{name}_q AS (
  SELECT {within} AS g, {key} AS k, CAST({votes} AS DOUBLE) AS v, {seats} AS n, CAST({most} AS BIGINT) AS most,
         {seats} * CAST({votes} AS DOUBLE) / sum(CAST({votes} AS DOUBLE)) OVER (PARTITION BY {within}) AS q,
         count(*) OVER (PARTITION BY {within}) AS parties
  FROM {parties} WHERE {votes} > 0),
{name}_t AS (
  SELECT *, unnest(range(1, least(most, CAST(ceil(q + q * parties / n + 2) AS BIGINT)) + 1)) AS seat FROM {name}_q WHERE n > 0),
{name} AS (
  SELECT g, k, count(*) AS quota FROM (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY v / (2 * seat - 1) DESC, k, seat) AS place FROM {name}_t)
  WHERE place <= n GROUP BY g, k)"""


OP4 = f"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, sum(size) AS source_size, count(*) AS n_rows FROM rows GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM sums),
weighed AS (
  SELECT *, CAST([3, 1, 2][idx % 3 + 1] AS DOUBLE) AS weight, CAST(source_size * 2 AS DOUBLE) AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 AS total FROM numbered),
filled AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM weighed),
leveled AS (SELECT *, rest / open_weight AS level, cap <= weight * (rest / open_weight) AS capped FROM filled),
targets AS (
  SELECT *, CASE WHEN capped THEN cap ELSE least(cap, weight * arg_min(level, (cap / weight, idx)) FILTER (NOT capped) OVER ()) END AS target FROM leveled),
seated AS (SELECT *, floor(sum(target) OVER () / 16 + 0.5) AS seats, 0 AS whole FROM targets),
{_seats("quotas", "seated", "whole", "idx", "target", "seats", "ceil(cap / 16)")},
known AS (SELECT s.*, coalesce(q.quota, 0) AS quota, CAST(ceil(n_rows / 2048) AS BIGINT) AS shards FROM seated s LEFT JOIN quotas q ON s.idx = q.k),
placed AS (
  SELECT r.doc_id, r.size, k.idx, k.source_size, k.target, tag, CAST('0x' || tag[1:8] AS BIGINT) % k.shards AS shard
  FROM (SELECT *, md5(concat_ws(':', '7', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR))) AS tag FROM rows) r
  JOIN known k ON r.source IS NOT DISTINCT FROM k.source),
shard_sums AS (
  SELECT p.idx, p.shard, sum(p.size) AS tokens, any_value(k.quota) AS quota FROM placed p JOIN known k ON p.idx = k.idx GROUP BY p.idx, p.shard),
{_seats("won", "shard_sums", "idx", "shard", "tokens", "quota", "ceil(tokens * 2 / 16)")},
runs AS (
  SELECT s.idx, s.shard, s.tokens, least(coalesce(w.quota, 0) * 16, s.tokens * 2) AS length,
         CASE WHEN s.tokens > 0 THEN CAST('0x' || md5(concat_ws(':', 'run7', s.idx, s.shard))[1:8] AS BIGINT) % CAST(ceil(s.tokens / 16) AS BIGINT) * 16 ELSE 0 END AS start
  FROM shard_sums s LEFT JOIN won w ON s.idx = w.g AND s.shard = w.k),
ring AS (
  SELECT *, sum(size) OVER (PARTITION BY idx, shard ORDER BY tag, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS x FROM placed)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST({_overlap(0)} + {_overlap(1)} + {_overlap(2)} AS BIGINT) AS taken
FROM ring JOIN runs USING (idx, shard)
"""

OP5 = f"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_WHITE}', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP10 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ITEM_WORD}') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ITEM_WORD}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
spans AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT s.doc_id, s.i, s.n, x.item_id FROM spans s JOIN windows x ON s.n = x.n AND s.t = x.t),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# Lines within one edit agree on their first or on their second half, cut by the shorter length.
OP9 = """
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
firsts AS (
  SELECT line, min((doc_id, no)) AS first FROM lines WHERE NOT regexp_full_match(line, '[\\x20\\x09-\\x0D]*') GROUP BY line),
halves AS (
  SELECT line, first, m, kind, CASE kind WHEN 'a' THEN line[1:m // 2] ELSE line[length(line) - (m - m // 2) + 1:] END AS half
  FROM (SELECT *, unnest([length(line), length(line) - 1]) AS m FROM firsts WHERE length(line) >= 20), (VALUES ('a'), ('b')) k(kind)),
met AS (
  SELECT DISTINCT x.line, x.first, y.line AS other FROM halves x JOIN halves y
  ON x.m = y.m AND x.kind = y.kind AND x.half = y.half AND y.first < x.first AND abs(length(x.line) - length(y.line)) <= 1),
same AS (
  SELECT *, list_position(list_transform(range(1, least(length(line), length(other)) + 1), lambda i: line[i] = other[i]), false) AS bad FROM met),
near AS (
  SELECT DISTINCT first FROM same WHERE bad IS NULL
  OR (length(line) = length(other) AND line[bad + 1:] = other[bad + 1:])
  OR (length(line) > length(other) AND line[bad + 1:] = other[bad:])
  OR (length(line) < length(other) AND line[bad:] = other[bad + 1:])),
stay AS (
  SELECT l.doc_id, l.no, l.line FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near n ON f.first = n.first
  WHERE f.line IS NULL OR (f.first = (l.doc_id, l.no) AND n.first IS NULL)),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY no) AS t FROM stay GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
       coalesce(n_kept, 0) AS n_kept, sha256(coalesce(t, '')) AS text_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""

OP2 = r"""
WITH p AS (
  SELECT page_id, url, '"' || md5(html) || '"' AS tag, page_id % 7 <> 0 AS tagged, CASE WHEN page_id % 5 = 0 THEN 'x' ELSE '' END AS changed,
         'day ' || page_id % 1000 AS modified, strlen(html) AS size, regexp_replace(trim(url), '#.*$', '') AS u FROM pages WHERE html IS NOT NULL),
q AS (SELECT *, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS r FROM p),
keyed AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(r, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(r, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS kept FROM q)),
stored AS (SELECT url_key, page_id * 60 AS at, page_id AS own, tag, tagged, modified, size FROM keyed),
revisits AS (SELECT page_id * 3 + k AS record_id, url_key, page_id * 60 + delay AS at, tag, tagged, changed, modified FROM keyed, (VALUES (1, 10), (2, 1000000000)) v(k, delay)),
met AS (
  SELECT r.*, s.own, s.tag AS old_tag, s.tagged AS old_tagged, s.modified AS old_modified, s.size
  FROM revisits r ASOF LEFT JOIN stored s ON r.url_key = s.url_key AND r.at > s.at),
judged AS (
  SELECT *, CASE WHEN own IS NULL THEN 'missing'
    WHEN CASE WHEN tagged AND old_tagged THEN changed || tag = old_tag ELSE changed || modified = old_modified END THEN 'matched' ELSE 'mismatch' END AS verdict FROM met),
merged AS (
  SELECT *, list_sort(list_filter(['cache-control: max-age=600', 'content-length: ' || size, 'content-type: text/html', 'last-modified: ' || changed || modified,
    CASE WHEN tagged THEN 'etag: W/' || changed || tag WHEN old_tagged THEN 'etag: ' || old_tag END], lambda x: x IS NOT NULL)) AS h FROM judged)
SELECT record_id, url_key, CASE WHEN verdict = 'matched' THEN own * 3 END AS matched_id, verdict,
       CASE WHEN verdict = 'matched' THEN len(h) END AS n_headers, CASE WHEN verdict = 'matched' THEN md5(array_to_string(h, chr(10))) END AS headers_md5
FROM merged
"""

def _strength(children: str) -> str:
    """Strength of a beta prior by moments, as in ``reputation.strength``."""
    rho = "sum((bad - n * mu) * (bad - n * mu) - n * mu * (1 - mu)) / nullif(sum(n * (n - 1) * mu * (1 - mu)), 0)"
    return f"(SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 4e0), 1000e0) ELSE 1000e0 END FROM (SELECT {rho} AS rho FROM {children}))"


# The posterior bound: Abramowitz and Stegun 26.5.21 at 0.3, with 1.2815515655446004 the normal 90 % point.
OP11 = f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
l AS (SELECT doc_id, max(CAST(greatest(toxic, 1 - quality) AS BIGINT)) AS bad FROM labels GROUP BY doc_id),
counts AS (SELECT host, count(l.bad) AS n, coalesce(sum(l.bad), 0) AS bad FROM p LEFT JOIN l ON p.page_id = l.doc_id GROUP BY host),
named AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS name FROM counts),
hosts AS (
  SELECT host, n, bad, string_split(name, '.')[-1] AS suffix, array_to_string(string_split(name, '.')[-2:], '.') AS domain FROM named),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (0.1e0 + sum(sum(bad)) OVER ()) / (1 + sum(sum(n)) OVER ()) AS mu FROM domains GROUP BY suffix),
s AS (SELECT suffix, (m * mu + bad) / (m + n) AS mu FROM suffixes, (SELECT {_strength("suffixes")} AS m)),
d0 AS (SELECT d.*, s.mu FROM domains d JOIN s USING (suffix)),
d AS (SELECT domain, suffix, (m * mu + bad) / (m + n) AS mu FROM d0, (SELECT {_strength("d0")} AS m)),
h0 AS (SELECT h.*, d.mu FROM hosts h JOIN d USING (domain, suffix)),
h AS (SELECT host, m * mu + bad AS a, m * (1 - mu) + n - bad AS b FROM h0, (SELECT {_strength("h0")} AS m)),
scored AS (SELECT *, pow(b * 0.3e0, 1e0 / 3) AS low, pow(a * 0.7e0, 1e0 / 3) AS high FROM h),
judged AS (
  SELECT host, 3 * (low * (1 - 1 / (9 * b)) - high * (1 - 1 / (9 * a))) / sqrt(low * low / b + high * high / a) <= -1.2815515655446004e0 AS blocked FROM scored),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN judged USING (host)
"""

def _round(no: int) -> str:
    """Assignment to the codebooks ``book{no}``; whole numbers in doubles are exact here."""
    return f"""
near{no} AS (
  SELECT x.key, x.part, arg_min(entry, (d, entry)) AS entry, min(d) AS far FROM (
    SELECT x.key, x.part, b.entry, list_inner_product(x.x, x.x) - 2 * list_inner_product(x.x, b.x) + list_inner_product(b.x, b.x) AS d
    FROM parts x JOIN book{no} b ON x.part = b.part) x
  GROUP BY x.key, x.part)"""


def _book(no: int) -> str:
    return f"""
book{no} AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{no - 1} b LEFT JOIN (
    SELECT part, entry, list(floor(total / n) ORDER BY i) AS x FROM (
      SELECT n.part, n.entry, i, sum(p.x[i]) AS total, count(*) AS n
      FROM near{no - 1} n JOIN parts p ON n.key = p.key AND n.part = p.part, range(1, len(p.x) + 1) r(i) GROUP BY n.part, n.entry, i)
    GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)"""


OP12 = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor(1024 * CAST(v AS DOUBLE))) AS x, row_number() OVER (ORDER BY vec_id) - 1 AS key
  FROM embeddings WHERE len(embedding) = len(list_filter(embedding, lambda v: coalesce(isfinite(v), false)))),
parts AS MATERIALIZED (SELECT key, part, x[part * len(x) // 4 + 1:(part + 1) * len(x) // 4] AS x FROM kept, range(4) r(part)),
book0 AS (SELECT part, key AS entry, x FROM parts WHERE key < 256),
{_round(0)}, {", ".join(_book(no) + ", " + _round(no) for no in range(1, 5))},
digest AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS i FROM book4)),
coded AS (SELECT key, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM near4 GROUP BY key)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (key), digest
"""

SQL = {"op2_warc_revisits": OP2, "op4_mixing": OP4, "op5_exact_dedup": OP5, "op9_line_dedup": OP9, "op10_decontamination": OP10, "op11_url_filters": OP11, "op12_vector_codes": OP12}
