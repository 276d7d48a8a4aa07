"""Clock, present and conflict-view queries (spark and sql twins)."""

from pyspark.sql import functions as F

from causalog.functions import clocks as C
from causalog.operators import present as P, resolve as R
from causalog.sources.recipes import N_SITES, cart_ops
from workload.spark_base import current, flat, log, table
from workload.sql_parts import frontier_cte, view_sql, with_log, with_present

SPARK, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


# conflict views: the whole log of a type resolved in one pass
for _name in R.VIEWS:
    _kind, _body = view_sql(_name)

    def _run(spark, sf_dir, name=_name, kind=_kind):
        return flat(R.view(name, current(spark, sf_dir, kind)))

    query(_name, with_present(_kind, _body))(_run)


# clock expressions: each operation against the next one of the same structure and site
_PAIRS = """pairs AS (
  SELECT o1.seq, o1.lts AS a, o2.lts AS b FROM ops o1 JOIN ops o2 ON o1.id = o2.id AND o2.seq = o1.seq + 40)"""
_LTE = "a[1] <= b[1] AND a[2] <= b[2] AND a[3] <= b[3]"
_GTE = "b[1] <= a[1] AND b[2] <= a[2] AND b[3] <= a[3]"


def _pairs(spark, sf_dir):
    ops = log(spark, sf_dir, "m").select("id", "seq", "lts")
    later = ops.select("id", (F.col("seq") - 40).alias("seq"), F.col("lts").alias("b"))
    return ops.withColumnRenamed("lts", "a").join(later, ["id", "seq"])


@query("vc_compare", with_log("m", f"""
SELECT seq, ({_LTE}) AS lte, ({_LTE}) AND NOT ({_GTE}) AS lt, NOT ({_LTE}) AND NOT ({_GTE}) AS concurrent,
  CAST(to_json([greatest(a[1], b[1]), greatest(a[2], b[2]), greatest(a[3], b[3])]) AS VARCHAR) AS top
FROM pairs""", more=_PAIRS))
def vc_compare(spark, sf_dir):
    return flat(_pairs(spark, sf_dir).select(
        "seq", C.vc_lte("a", "b").alias("lte"), C.vc_lt("a", "b", N_SITES).alias("lt"),
        C.vc_concurrent("a", "b", N_SITES).alias("concurrent"), C.vc_max("a", "b").alias("top"),
    ))


@query("vc_pad_inc", with_log("m", """
SELECT seq, CAST(to_json([lts[1], lts[2], lts[3], 0, 0]) AS VARCHAR) AS padded,
  CAST(to_json([lts[1] + (site = 1)::BIGINT, lts[2] + (site = 2)::BIGINT, lts[3] + (site = 3)::BIGINT]) AS VARCHAR) AS stepped,
  '[0,0,0]' AS zero FROM ops"""))
def vc_pad_inc(spark, sf_dir):
    return flat(log(spark, sf_dir, "m").select(
        "seq", C.vc_pad("lts", 5).alias("padded"), C.vc_inc("lts", F.col("site")).alias("stepped"),
        C.vc_zero(N_SITES).alias("zero"),
    ))


@query("vc_max_agg", with_log("m", "SELECT id, CAST(to_json([max(lts[1]), max(lts[2]), max(lts[3])]) AS VARCHAR) AS lts FROM ops GROUP BY id"))
def vc_max_agg(spark, sf_dir):
    return flat(C.vc_max_agg(log(spark, sf_dir, "m"), ["id"], N_SITES))


@query("hlc_order", with_log("m", "SELECT id, max(pt * 10 + lt) AS newest FROM ops GROUP BY id"))
def hlc_order(spark, sf_dir):
    top = log(spark, sf_dir, "m").groupBy("id").agg(F.max(C.hlc_order("pts")).alias("p"))
    return top.select("id", (F.col("p.physical_time") * 10 + F.col("p.logical_time")).alias("newest"))


@query("hlc_next_step", with_log("m", """
SELECT seq, CASE WHEN pt + seq % 3 - 1 > pt THEN pt + seq % 3 - 1 ELSE pt END AS physical_time,
  CASE WHEN pt + seq % 3 - 1 > pt THEN 1 ELSE lt + 1 END AS logical_time FROM ops"""))
def hlc_next_step(spark, sf_dir):
    wall = F.col("pts.physical_time") + F.col("seq") % 3 - 1
    return log(spark, sf_dir, "m").select("seq", C.hlc_next("pts", wall).alias("n")).select("seq", "n.*")


# causal present
_FRONT = "SELECT id, key, site, CAST(to_json(lts) AS VARCHAR) AS lts, op, data FROM cur"


def _front(df):
    return flat(df.select("id", "key", "site", "lts", "op", "data"))


@query("causal_present", with_present("m", _FRONT))
def causal_present(spark, sf_dir):
    return _front(P.causal_present(log(spark, sf_dir, "m"), N_SITES, mode="causal"))


@query("causal_present_exact", with_present("m", _FRONT))
def causal_present_exact(spark, sf_dir):
    return _front(P.causal_present(log(spark, sf_dir, "m"), N_SITES, mode="exact"))


# Clocks no vector-clock protocol would produce, so the exact frontier cannot rely on causality.
_SCATTER = """scatter AS (
  SELECT DISTINCT event_type AS id, CAST(user_id % 8 AS VARCHAR) AS key, CAST(1 + event_id % 3 AS INTEGER) AS site,
    [(event_id * 7919) % 211, (event_id * 104729) % 223, (event_id * 1299709) % 227] AS lts
  FROM events)"""


def _scatter(spark, sf_dir):
    e = F.col("event_id")
    lts = F.array(e * 7919 % 211, e * 104729 % 223, e * 1299709 % 227)
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("id"), (F.col("user_id") % 8).cast("string").alias("key"),
        (1 + e % 3).cast("int").alias("site"), lts.alias("lts"),
    )


@query("causal_present_any_clocks", f"""
WITH {_SCATTER}, {frontier_cte('scatter')}
SELECT id, key, site, CAST(to_json(lts) AS VARCHAR) AS lts FROM cur""")
def causal_present_any_clocks(spark, sf_dir):
    return flat(P.causal_present(_scatter(spark, sf_dir), N_SITES, mode="exact"))


_TOPS = """tops AS (
  SELECT t.* FROM {0} t JOIN (SELECT id, key, max(lts[1]) m1, max(lts[2]) m2, max(lts[3]) m3 FROM {0} GROUP BY id, key) m
  ON t.id = m.id AND t.key = m.key AND (t.lts[1] = m.m1 OR t.lts[2] = m.m2 OR t.lts[3] = m.m3))"""


@query("causal_present_prefilter", f"""
WITH {_SCATTER}, {_TOPS.format('scatter')}, {frontier_cte('tops')}
SELECT id, key, site, CAST(to_json(lts) AS VARCHAR) AS lts FROM cur""")
def causal_present_prefilter(spark, sf_dir):
    return flat(P.causal_present(_scatter(spark, sf_dir), N_SITES, mode="exact", prefilter=True))


@query("coordinate_max_candidates", with_log("m", "SELECT seq, id, key FROM tops", more=_TOPS.format("ops")))
def coordinate_max_candidates(spark, sf_dir):
    return P.coordinate_max_candidates(log(spark, sf_dir, "m"), N_SITES).select("seq", "id", "key")


@query("causal_present_sparse", with_present("m", _FRONT, window=64))
def causal_present_sparse(spark, sf_dir):
    return _front(P.causal_present(log(spark, sf_dir, "m", 64), N_SITES, mode="causal"))


_HALF = "(SELECT max(event_id) // 2 FROM events)"


def _halves(spark, sf_dir, kind, window=2048):
    """Rows merged so far and rows still only in the log, cut at the middle event."""
    ops = log(spark, sf_dir, kind, window)
    top = table(spark, sf_dir, "events").agg(F.floor(F.max("event_id") / 2)).scalar()
    early, late = ops.where(F.col("seq") <= top), ops.where(F.col("seq") > top)
    local = P.causal_present(early, N_SITES, mode="causal").withColumn("merged_at", F.col("arrival_time"))
    return local.drop("seq", "hops", "arrival_time"), late


_LOCAL = f"early AS (SELECT * FROM ops WHERE seq <= {_HALF}), late AS (SELECT * FROM ops WHERE seq > {_HALF}), {frontier_cte('early', 'loc')}"
_UNION = "both_rows AS (SELECT *, pt AS merged_at FROM loc UNION ALL SELECT *, NULL FROM late)"


@query("local_and_shared", with_log("m", "SELECT id, key, site, CAST(to_json(lts) AS VARCHAR) AS lts, merged_at FROM both_rows", more=f"{_LOCAL}, {_UNION}"))
def local_and_shared(spark, sf_dir):
    return flat(P.local_and_shared(*_halves(spark, sf_dir, "m")).select("id", "key", "site", "lts", "merged_at"))


@query("present_all", with_log("m", "SELECT id, key, site, op, data, merged_at FROM cur", more=f"{_LOCAL}, {_UNION}, {frontier_cte('both_rows')}"))
def present_all(spark, sf_dir):
    local, shared = _halves(spark, sf_dir, "m")
    return P.present(local, shared, N_SITES, "all", "causal").select("id", "key", "site", "op", "data", "merged_at")


@query("present_local", with_log("m", "SELECT id, key, site, op, data, pt AS merged_at FROM loc", more=_LOCAL))
def present_local(spark, sf_dir):
    local, shared = _halves(spark, sf_dir, "m")
    return P.present(local, shared, N_SITES, "local").select("id", "key", "site", "op", "data", "merged_at")


@query("all_rows", with_log("m", "SELECT id, count(*) AS n, count(merged_at) AS merged FROM both_rows GROUP BY id", more=f"{_LOCAL}, {_UNION}"))
def all_rows(spark, sf_dir):
    local, shared = _halves(spark, sf_dir, "m")
    return P.all_rows(local, shared, "all").groupBy("id").agg(F.count("*").alias("n"), F.count("merged_at").alias("merged"))


@query("dedup_ops", with_log("m", "SELECT id, key, site, CAST(to_json(lts) AS VARCHAR) AS lts, op, seq FROM ops"))
def dedup_ops(spark, sf_dir):
    ops = log(spark, sf_dir, "m")
    later = ops.withColumn("hops", F.lit(1))
    return flat(P.dedup_ops(ops.unionByName(later).unionByName(ops)).where("hops = 0").select("id", "key", "site", "lts", "op", "seq"))


@query("list_pages", with_present("l", """
SELECT id, page, CAST(to_json(list(data ORDER BY pos)) AS VARCHAR) AS data FROM (
  SELECT id, data, key AS pos, (row_number() OVER (PARTITION BY id ORDER BY key) - 1) // 10 AS page FROM cur WHERE op <> 'r')
GROUP BY id, page"""))
def list_pages(spark, sf_dir):
    return flat(R.pages(R.list_unsorted(current(spark, sf_dir, "l")), "pos", 10))


# typed tables
_CART = """cart AS (
  SELECT o_custkey AS cart_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
    CASE WHEN l_returnflag = 'R' THEN 'r' ELSE 'a' END AS op, CAST(1 + l_linenumber % 3 AS INTEGER) AS site,
    [l_orderkey, CAST(l_linenumber AS BIGINT), CAST(l_quantity AS BIGINT)] AS lts, epoch_us(o_orderdate) // 1000 AS pt, l_linenumber AS lt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_CART_LWW = f"""{_CART}, lww AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY cart_id, product_id ORDER BY pt DESC, lt DESC, site, lts) rn FROM cart) WHERE rn = 1 AND op <> 'r')"""


def _cart(spark, sf_dir):
    return cart_ops(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


@query("cart_lww", f"WITH {_CART_LWW} SELECT cart_id, product_id, quantity FROM lww")
def cart_lww(spark, sf_dir):
    return R.cart_lww(_cart(spark, sf_dir))


@query("cart_products", f"WITH {_CART_LWW} SELECT product_id, quantity FROM lww WHERE cart_id = 7")
def cart_products(spark, sf_dir):
    return R.cart_products(_cart(spark, sf_dir), 7)


@query("carts_with_product_range", f"WITH {_CART_LWW} SELECT DISTINCT cart_id FROM lww WHERE product_id BETWEEN 20 AND 60")
def carts_with_product_range(spark, sf_dir):
    return R.carts_with_product_range(_cart(spark, sf_dir), 20, 60)


for _rule, _having in {
    "aw": "SELECT *, row_number() OVER (PARTITION BY cart_id, product_id ORDER BY pt DESC, lt DESC, site, lts) rn FROM cart WHERE op <> 'r'",
    "rw": "SELECT * FROM (SELECT *, row_number() OVER w rn, bool_and(op <> 'r') OVER (PARTITION BY cart_id, product_id) ok FROM cart WINDOW w AS (PARTITION BY cart_id, product_id ORDER BY pt DESC, lt DESC, site, lts)) WHERE ok",
}.items():
    def _run(spark, sf_dir, rule=_rule):
        return R.resolve(_cart(spark, sf_dir), ["cart_id", "product_id"], rule).select("cart_id", "product_id", "quantity", "site")

    query(f"resolve_typed_{_rule}", f"WITH {_CART} SELECT cart_id, product_id, quantity, site FROM ({_having}) WHERE rn = 1")(_run)
