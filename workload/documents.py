"""Nested-document queries: nations hold customers, customers orders, orders parts."""

from pyspark.sql import functions as F

from causalog.functions.clocks import hlc
from causalog.operators import nested as N
from workload.spark_base import table

SPARK, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def _text(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _rows(df, id_, key, kind, data, site):
    return df.select(
        id_.alias("id"), key.cast("string").alias("key"), F.lit(kind).alias("type"), data.cast("string").alias("data"),
        site.cast("int").alias("site"), F.array(site.cast("long")).alias("lts"),
        hlc(F.lit(0), F.lit(1)).alias("pts"), F.lit("a").alias("op"), F.lit(0).cast("long").alias("merged_at"),
    )


def documents(spark, sf_dir, parts):
    """The present of the named structure groups."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    cust, order = _text("cust-", "o_custkey"), _text("ord-", "o_orderkey")
    one, none = F.lit(1), F.lit(None)
    price = F.floor("o_totalprice").cast("long")
    groups = {
        "nation_set": lambda: _rows(c, _text("nation-", "c_nationkey"), _text("cust-", "c_custkey"), "s", none, one),
        "cust_map": lambda: _rows(o, cust, F.col("o_orderkey"), "m", order, one),
        "cust_mvr": lambda: _rows(o, cust, F.col("o_orderpriority"), "m", order, F.col("o_orderkey")),
        "cust_list": lambda: _rows(o, cust, F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), "l", order, one),
        "cust_register": lambda: _rows(o, cust, F.lit(""), "r", order, F.col("o_orderkey")),
        "ord_set": lambda: _rows(li, _text("ord-", "l_orderkey"), F.col("l_partkey"), "s", none, one),
        "ord_counter": lambda: _rows(o, order, F.lit("1"), "c", price, one),
        "ord_register": lambda: _rows(o, order, F.lit(""), "r", F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"')), one),
    }
    out = None
    for part in parts:
        rows = groups[part]()
        out = rows if out is None else out.unionByName(rows)
    return out


_SET = """ord_set AS (SELECT 'ord-' || l_orderkey AS id, '[' || string_agg('"' || p || '"', ',' ORDER BY p) || ']' AS j
  FROM (SELECT DISTINCT l_orderkey, CAST(l_partkey AS VARCHAR) AS p FROM lineitem) GROUP BY l_orderkey)"""
_MAP = """cust_map AS (SELECT 'cust-' || o_custkey AS id, '{' || string_agg('"' || o_orderkey || '":' || j, ',' ORDER BY o_orderkey) || '}' AS j
  FROM orders JOIN ord_set s ON s.id = 'ord-' || o_orderkey GROUP BY o_custkey)"""


def _docs(path, parts, roots=None):
    def run(spark, sf_dir):
        return N.nested_json(documents(spark, sf_dir, parts), path, roots(spark, sf_dir) if roots else None)
    return run


query("nested_json_map_set", f"WITH {_SET}, {_MAP} SELECT id, j AS data FROM cust_map")(
    _docs(["map_lww", "set_aw"], ["cust_map", "ord_set"]))

query("nested_json_set_map_set", f"""WITH {_SET}, {_MAP}
SELECT 'nation-' || c_nationkey AS id, '[' || string_agg(j, ',' ORDER BY id) || ']' AS data
FROM customer JOIN cust_map ON id = 'cust-' || c_custkey GROUP BY c_nationkey""")(
    _docs(["SetAw", "MapAwLww", "SetRw"], ["nation_set", "cust_map", "ord_set"]))

query("nested_json_list_counter", """
SELECT 'cust-' || o_custkey AS id, '[' || string_agg(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), ',' ORDER BY o_orderkey) || ']' AS data
FROM orders GROUP BY o_custkey""")(_docs(["list", "counter"], ["cust_list", "ord_counter"]))

query("nested_json_mvr_set", f"""WITH {_SET}, lists AS (
  SELECT o_custkey, o_orderpriority AS k, '[' || string_agg(j, ',' ORDER BY o_orderkey) || ']' AS j
  FROM orders JOIN ord_set s ON s.id = 'ord-' || o_orderkey GROUP BY ALL)
SELECT 'cust-' || o_custkey AS id, '{{' || string_agg('"' || k || '":' || j, ',' ORDER BY length(k), k) || '}}' AS data FROM lists GROUP BY o_custkey""")(
    _docs(["map_aw_mvr", "set_lww"], ["cust_mvr", "ord_set"]))

query("nested_json_register_register", """
SELECT 'cust-' || o_custkey AS id, '[' || string_agg('"\\"' || o_orderpriority || '\\""', ',' ORDER BY o_orderkey) || ']' AS data
FROM orders GROUP BY o_custkey""")(_docs(["register_mvr", "register_lww"], ["cust_register", "ord_register"]))

query("nested_json_register_lww", """
SELECT 'cust-' || o_custkey AS id, CAST(CAST(floor(arg_min(o_totalprice, o_orderkey)) AS BIGINT) AS VARCHAR) AS data
FROM orders GROUP BY o_custkey""")(_docs(["register_lww", "counter"], ["cust_register", "ord_counter"]))

query("nested_json_leaf_mvr", """
SELECT id, '{' || string_agg('"' || k || '":' || j, ',' ORDER BY length(k), k) || '}' AS data FROM (
  SELECT 'cust-' || o_custkey AS id, o_orderpriority AS k, '[' || string_agg('"ord-' || o_orderkey || '"', ',' ORDER BY o_orderkey) || ']' AS j
  FROM orders GROUP BY ALL) GROUP BY id""")(_docs(["map_rw_mvr"], ["cust_mvr"]))


def _building(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return c.select(_text("cust-", "c_custkey").alias("id"))


query("nested_json_roots", f"""WITH {_SET}, {_MAP} SELECT id, j AS data FROM cust_map
WHERE id IN (SELECT 'cust-' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")(
    _docs(["map_lww", "set_aw"], ["cust_map", "ord_set"], _building))


@query("nested_chunks", f"""WITH {_SET}, {_MAP}, docs AS (
  SELECT 'nation-' || c_nationkey AS id, '[' || string_agg(j, ',' ORDER BY id) || ']' AS j
  FROM customer JOIN cust_map ON id = 'cust-' || c_custkey GROUP BY c_nationkey),
parts AS (SELECT id, j, unnest(range((length(j) + 4095) // 4096)) AS part FROM docs)
SELECT id, part, substr(j, part * 4096 + 1, 4096) AS text FROM parts""")
def nested_chunks(spark, sf_dir):
    """Whole nations, a document of which no row could hold at scale."""
    return N.nested_chunks(documents(spark, sf_dir, ["nation_set", "cust_map", "ord_set"]), ["set_aw", "map_aw_lww", "set_rw"], chars=4096)


@query("nested_rows", """
SELECT DISTINCT 'cust-' || o_custkey AS id0, CAST(o_orderkey AS VARCHAR) AS key0, 'ord-' || o_orderkey AS id1, CAST(l_partkey AS VARCHAR) AS data
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def nested_rows(spark, sf_dir):
    return N.nested_rows(documents(spark, sf_dir, ["cust_map", "ord_set"]), ["map_lww", "set_aw"])


@query("nested_rows_list", """
SELECT 'nation-' || c_nationkey AS id0, 'cust-' || c_custkey AS id1, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS pos1,
  'ord-' || o_orderkey AS id2, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS data
FROM customer JOIN orders ON c_custkey = o_custkey""")
def nested_rows_list(spark, sf_dir):
    return N.nested_rows(documents(spark, sf_dir, ["nation_set", "cust_list", "ord_counter"]), ["set_aw", "list", "counter"])
