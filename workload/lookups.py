"""Look-up, merge, audit and encoding queries."""

from pyspark.sql import functions as F

from causalog.operators import audit as A, encodings as E, lookup as L, merge as M, resolve as R
from causalog.operators.present import causal_present
from causalog.sources import ops as S
from causalog.sources.recipes import N_SITES
from workload.spark_base import current, flat, folder, log, table
from workload.sql_parts import VIEW_SQL, frontier_cte, view_sql, with_log, with_present
from workload.views import _LOCAL, _halves

SPARK, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


# Probe ids: one per customer, so some structures exist and many do not.
def _ids(spark, sf_dir, kind):
    ids = table(spark, sf_dir, "customer").select(F.concat(F.lit(kind + "-"), (F.col("c_custkey") % 50).cast("string")).alias("id"))
    return ids.distinct()


def _ids_sql(kind):
    return f"ids AS (SELECT DISTINCT '{kind}-' || CAST(c_custkey % 50 AS VARCHAR) AS id FROM customer)"


_GETS = {
    "register_get_mvr": ("register_mvr", lambda i, p: L.register_get(i, p, "mvr")),
    "register_get_lww": ("register_lww", lambda i, p: L.register_get(i, p, "lww")),
    "set_get_aw": ("set_aw_tuple", lambda i, p: L.set_get(i, p, "aw")),
    "set_get_rw": ("set_rw_tuple", lambda i, p: L.set_get(i, p, "rw")),
    "set_get_lww": ("set_lww_tuple", lambda i, p: L.set_get(i, p, "lww")),
    "map_get_aw_mvr": ("map_aw_mvr_tuple", lambda i, p: L.map_get(i, p, "aw_mvr")),
    "map_get_aw_lww": ("map_aw_lww_tuple", lambda i, p: L.map_get(i, p, "aw_lww")),
    "map_get_rw_mvr": ("map_rw_mvr_tuple", lambda i, p: L.map_get(i, p, "rw_mvr")),
    "map_get_lww": ("map_lww_tuple", lambda i, p: L.map_get(i, p, "lww")),
    "counter_get": ("counter", L.counter_get),
    "list_get": ("list_tuple", L.list_get),
}
for _name, (_view, _fn) in _GETS.items():
    _kind, _body = view_sql(_view)

    def _run(spark, sf_dir, kind=_kind, fn=_fn):
        return flat(fn(_ids(spark, sf_dir, kind), current(spark, sf_dir, kind)))

    query(_name, with_present(_kind, f"SELECT ids.id, v.data FROM ids LEFT JOIN ({_body}) v ON ids.id = v.id", more=_ids_sql(_kind)))(_run)


@query("counter_get_all", with_present("c", VIEW_SQL["counter"][1]))
def counter_get_all(spark, sf_dir):
    return L.counter_get_all(current(spark, sf_dir, "c"))


@query("counter_get_multiple", with_present("c", f"SELECT v.* FROM ({VIEW_SQL['counter'][1]}) v WHERE id IN (SELECT id FROM ids)", more=_ids_sql("c")))
def counter_get_multiple(spark, sf_dir):
    return L.counter_get_multiple(_ids(spark, sf_dir, "c"), current(spark, sf_dir, "c"))


# Element probes: every (structure, event type) pair customers and a type list span.
_TYPES = ("view", "click", "error", "nothing")


def _elements(spark, sf_dir, kind, name):
    types = F.explode(F.array(*[F.lit(t) for t in _TYPES]))
    return _ids(spark, sf_dir, kind).select("id", types.alias(name))


def _elements_sql(kind, name):
    return f"{_ids_sql(kind)}, probes AS (SELECT id, unnest([{', '.join(repr(t) for t in _TYPES)}]) AS {name} FROM ids)"


for _mode in ("aw", "rw", "lww"):
    def _run(spark, sf_dir, mode=_mode):
        return L.set_contains(_elements(spark, sf_dir, "s", "elem"), current(spark, sf_dir, "s"), mode)

    query(f"set_contains_{_mode}", with_present("s", f"""
SELECT p.id, p.elem, v.id IS NOT NULL AS contains FROM probes p
LEFT JOIN ({VIEW_SQL['set_' + _mode][1]}) v ON p.id = v.id AND p.elem = v.data""", more=_elements_sql("s", "elem")))(_run)

for _mode in ("aw_mvr", "aw_lww", "rw_mvr", "lww"):
    _body = VIEW_SQL["map_" + _mode][1]

    def _run(spark, sf_dir, mode=_mode):
        return flat(L.map_value(_elements(spark, sf_dir, "m", "key"), current(spark, sf_dir, "m"), mode))

    _value = "CAST(to_json(v.value) AS VARCHAR)" if _mode.endswith("mvr") else "v.value"
    query(f"map_value_{_mode}", with_present("m", f"""
SELECT p.id, p.key, {_value} AS value FROM probes p
LEFT JOIN ({_body}) v ON p.id = v.id AND p.key = v.key""", more=_elements_sql("m", "key")))(_run)

    def _run(spark, sf_dir, mode=_mode):
        return L.map_contains(_elements(spark, sf_dir, "m", "key"), current(spark, sf_dir, "m"), mode)

    query(f"map_contains_{_mode}", with_present("m", f"""
SELECT p.id, p.key, v.id IS NOT NULL AS contains FROM probes p
LEFT JOIN ({_body}) v ON p.id = v.id AND p.key = v.key""", more=_elements_sql("m", "key")))(_run)


_RANKED = "ranked AS (SELECT id, key AS pos, data, row_number() OVER (PARTITION BY id ORDER BY key, site, pt DESC, lt DESC) - 1 AS index FROM cur WHERE op <> 'r')"


@query("list_get_at", with_present("l", """
SELECT p.id, p.index, r.data FROM (SELECT id, unnest([0, 3, 20, 5000]) AS index FROM ids) p
LEFT JOIN ranked r ON p.id = r.id AND p.index = r.index""", more=f"{_ids_sql('l')}, {_RANKED}"))
def list_get_at(spark, sf_dir):
    at = F.explode(F.array(*[F.lit(i) for i in (0, 3, 20, 5000)]))
    return L.list_get_at(_ids(spark, sf_dir, "l").select("id", at.alias("index")), current(spark, sf_dir, "l"))


@query("list_ranks", with_present("l", "SELECT * FROM ranked", more=_RANKED))
def list_ranks(spark, sf_dir):
    return L.list_ranks(current(spark, sf_dir, "l"))


for _name, _fn, _agg in (("list_first", L.list_first, "arg_min"), ("list_last", L.list_last, "arg_max")):
    def _run(spark, sf_dir, fn=_fn):
        return fn(_ids(spark, sf_dir, "l"), current(spark, sf_dir, "l"))

    query(_name, with_present("l", f"""
SELECT ids.id, v.data FROM ids LEFT JOIN (SELECT id, {_agg}(data, pos) AS data FROM ranked GROUP BY id) v ON ids.id = v.id""",
          more=f"{_ids_sql('l')}, {_RANKED}"))(_run)


# sources and filters
def _broken(spark, sf_dir):
    """Two-site log with an unknown structure type on one key and foreign sites."""
    ops = log(spark, sf_dir, "m").withColumn("lts", F.slice("lts", 1, 2))
    return ops.withColumn("type", F.when(F.col("key") == "view", "x").otherwise(F.col("type")))


def _reread(spark, sf_dir):
    """That log written in several files by two appends, and read back."""
    path = folder(spark, "read-ops")
    for part in (F.col("seq") % 2 == 0, F.col("seq") % 2 == 1):
        S.append_ops(_broken(spark, sf_dir).where(part), path)
    return S.read_ops(spark, path, 2)


@query("read_ops", with_log("m", "SELECT id, key, site, op, seq FROM ops WHERE key <> 'view' AND site <= 2"))
def read_ops(spark, sf_dir):
    return _reread(spark, sf_dir)[0].select("id", "key", "site", "op", "seq")


@query("read_ops_rejects", with_log("m", "SELECT id, key, site, op, seq FROM ops WHERE key = 'view' OR site > 2"))
def read_ops_rejects(spark, sf_dir):
    return _reread(spark, sf_dir)[1].select("id", "key", "site", "op", "seq")


@query("filter_like", with_present("c", f"SELECT * FROM ({VIEW_SQL['counter'][1]}) v WHERE id LIKE 'c-1%'"))
def filter_like(spark, sf_dir):
    return S.filter_like(R.counter(current(spark, sf_dir, "c")), "c-1%")


@query("filter_ids", with_present("r", f"SELECT v.* FROM ({VIEW_SQL['register_lww'][1]}) v WHERE id IN (SELECT id FROM ids)", more=_ids_sql("r")))
def filter_ids(spark, sf_dir):
    return S.filter_ids(R.register_lww(current(spark, sf_dir, "r")), _ids(spark, sf_dir, "r"))


@query("clone_structure", with_present("m", "SELECT 'copy-' || CAST(i AS VARCHAR) AS id, key, site, op, data FROM cur, range(1, 26) t(i) WHERE id = 'm-7'"))
def clone_structure(spark, sf_dir):
    return S.clone_structure(current(spark, sf_dir, "m"), "m-7", "copy-", 25).select("id", "key", "site", "op", "data")


_GENERATED = {"r": ("''", "'v'"), "s": ("CAST(i AS VARCHAR)", "NULL"), "m": ("CAST(i AS VARCHAR)", "'v'"),
              "c": ("'1'", "'0'"), "l": ("lpad(CAST(i AS VARCHAR), 12, '0') || '1'", "'v'")}
for _kind, (_key, _data) in _GENERATED.items():
    def _run(spark, sf_dir, kind=_kind):
        ids = table(spark, sf_dir, "customer").select(F.concat(F.lit(kind + "-"), F.col("c_custkey").cast("string")).alias("id"))
        return flat(S.generate_ops(ids, kind, 5, N_SITES))

    _n = 1 if _kind in "rc" else 5
    query(f"generate_ops_{_kind}", f"""
SELECT '{_kind}-' || CAST(c_custkey AS VARCHAR) AS id, {_key} AS key, '{_kind}' AS type, {_data} AS data, 1 AS site,
  CAST(to_json([i + 1, 0, 0]) AS VARCHAR) AS lts,
  CAST(to_json({{'physical_time': 0, 'logical_time': i + 1}}) AS VARCHAR) AS pts, 'a' AS op
FROM customer, range({_n}) t(i)""")(_run)


@query("generate_nested_ops", """
SELECT 'm-' || CAST(c_custkey AS VARCHAR) || '-' || CAST(j AS VARCHAR) AS id, 'k-1' AS key,
  'm-' || CAST(c_custkey AS VARCHAR) || '-' || CAST(j + 1 AS VARCHAR) AS data FROM customer, range(1, 5) t(j)""")
def generate_nested_ops(spark, sf_dir):
    roots = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("root"))
    return S.generate_nested_ops(roots, 4, N_SITES).select("id", "key", "data")


# merge
_PRES = "id, key, site, CAST(to_json(lts) AS VARCHAR) AS lts, op, data"


def _pres(df):
    return flat(df.select("id", "key", "site", "lts", "op", "data"))


_DOM = "{a}.id = {b}.id AND {a}.key = {b}.key AND {a}.lts[1] <= {b}.lts[1] AND {a}.lts[2] <= {b}.lts[2] AND {a}.lts[3] <= {b}.lts[3]"


@query("drop_obsolete", with_log("m", f"SELECT {_PRES} FROM ops o WHERE NOT EXISTS (SELECT 1 FROM loc WHERE {_DOM.format(a='o', b='loc')})", more=_LOCAL))
def drop_obsolete(spark, sf_dir):
    local, _ = _halves(spark, sf_dir, "m")
    return _pres(M.drop_obsolete(log(spark, sf_dir, "m"), local, N_SITES))


@query("superseded", with_log("m", f"SELECT {_PRES} FROM loc WHERE EXISTS (SELECT 1 FROM late WHERE {_DOM.format(a='loc', b='late')} AND loc.lts <> late.lts)", more=_LOCAL))
def superseded(spark, sf_dir):
    local, late = _halves(spark, sf_dir, "m")
    return _pres(M.superseded(local, late, N_SITES, "causal"))


_MERGED = "SELECT id, key, site, CAST(to_json(lts) AS VARCHAR) AS lts, op, data, pt AS merged_at FROM cur"


@query("merge_ops", with_present("m", _MERGED))
def merge_ops(spark, sf_dir):
    local, late = _halves(spark, sf_dir, "m")
    return flat(M.merge_ops(local, late, N_SITES, "causal").select("id", "key", "site", "lts", "op", "data", "merged_at"))


@query("merge_ops_replayed", with_present("m", _MERGED))
def merge_ops_replayed(spark, sf_dir):
    local, _ = _halves(spark, sf_dir, "m")
    return flat(M.merge_ops(local, log(spark, sf_dir, "m"), N_SITES, "exact").select("id", "key", "site", "lts", "op", "data", "merged_at"))


@query("receive_ops", with_log("m", f"""
SELECT id, key, site, CAST(to_json(lts) AS VARCHAR) AS lts, CASE WHEN site <> 1 THEN 1 ELSE 0 END AS hops, 99 AS arrival_time
FROM ops o WHERE key <> 'click' AND NOT EXISTS (SELECT 1 FROM loc WHERE {_DOM.format(a='o', b='loc')})""", more=_LOCAL))
def receive_ops(spark, sf_dir):
    local, _ = _halves(spark, sf_dir, "m")
    ops = log(spark, sf_dir, "m")
    known = ops.where("key = 'click'")
    got = M.receive_ops(ops.unionByName(ops), 1, local, known, 99, N_SITES)
    return flat(got.select("id", "key", "site", "lts", "hops", "arrival_time"))


@query("forwardable", with_log("m", "SELECT id, key, seq FROM ops WHERE seq % 5 < 3"))
def forwardable(spark, sf_dir):
    ops = log(spark, sf_dir, "m").withColumn("hops", (F.col("seq") % 5).cast("int"))
    return M.forwardable(ops).select("id", "key", "seq")


@query("forwardable_ring", with_log("m", "SELECT id, key, seq FROM ops WHERE site <> 2"))
def forwardable_ring(spark, sf_dir):
    return M.forwardable(log(spark, sf_dir, "m"), next_site=2).select("id", "key", "seq")


@query("wall_clock", with_log("m", "SELECT site, max(pt) AS physical_time FROM ops GROUP BY site"))
def wall_clock(spark, sf_dir):
    return M.wall_clock(log(spark, sf_dir, "m"))


@query("backlog", with_log("m", f"SELECT site, count(*) AS unmerged FROM ops o WHERE NOT EXISTS (SELECT 1 FROM loc WHERE {_DOM.format(a='o', b='loc')}) GROUP BY site", more=_LOCAL))
def backlog(spark, sf_dir):
    local, _ = _halves(spark, sf_dir, "m")
    return M.backlog(log(spark, sf_dir, "m"), local, N_SITES)


@query("fully_merged", with_log("m", f"SELECT count(*) = 0 AS fully_merged FROM ops o WHERE NOT EXISTS (SELECT 1 FROM loc WHERE {_DOM.format(a='o', b='loc')})", more=_LOCAL))
def fully_merged(spark, sf_dir):
    local, _ = _halves(spark, sf_dir, "m")
    return M.fully_merged(log(spark, sf_dir, "m"), local, N_SITES)


# audit: site s knows its own operations and the others' up to s quarters of the log
def _known(ops, top, site):
    return ops.where((F.col("site") == site) | (F.col("seq") * 4 < top * site))


def _replicas(spark, sf_dir, kind="m"):
    ops = log(spark, sf_dir, kind, 64)
    top = table(spark, sf_dir, "events").agg(F.max("event_id")).scalar()
    out = []
    for s in (1, 2, 3):
        out.append(causal_present(_known(ops, top, s), N_SITES, mode="causal").withColumn("replica", F.lit(s)))
    return out[0].unionByName(out[1]).unionByName(out[2])


_TOP = "(SELECT max(event_id) FROM events)"
_REPLICAS = ", ".join(
    f"k{s} AS (SELECT * FROM ops WHERE site = {s} OR seq * 4 < {_TOP} * {s}), {frontier_cte(f'k{s}', f'p{s}')}" for s in (1, 2, 3)
)
_DIGEST = "SELECT {s} AS replica, id, string_agg(key || '|' || CAST(site AS VARCHAR) || '|' || CAST(lts AS VARCHAR) || '|' || op || '|' || coalesce(data, '-'), ';' ORDER BY key, site, lts) AS d FROM p{s} GROUP BY id"


@query("converged", with_log("m", f"""
SELECT id, count(*) = 3 AND count(DISTINCT d) = 1 AS converged
FROM ({' UNION ALL '.join(_DIGEST.format(s=s) for s in (1, 2, 3))}) GROUP BY id""", window=64, more=_REPLICAS))
def converged(spark, sf_dir):
    return A.converged(_replicas(spark, sf_dir), 3)


@query("missing_ops", with_log("m", f"SELECT id, key, seq FROM ops WHERE (site = 3 OR seq * 4 < {_TOP} * 3) AND NOT (site = 1 OR seq * 4 < {_TOP})", window=64))
def missing_ops(spark, sf_dir):
    ops = log(spark, sf_dir, "m", 64)
    top = table(spark, sf_dir, "events").agg(F.max("event_id")).scalar()
    return A.missing_ops(_known(ops, top, 3), _known(ops, top, 1)).select("id", "key", "seq")


@query("check_causal", with_log("m", """
SELECT o.id, o.site, o.lts[o.site] AS own, 'gap' AS reason FROM ops o JOIN ops p
ON o.id = p.id AND o.site = p.site AND o.lts[o.site] = p.lts[p.site] + 1
WHERE o.key <> 'signup' AND p.key = 'signup'"""))
def check_causal(spark, sf_dir):
    """A log that lost its sign-ups: every operation whose predecessor is gone is reported."""
    return A.check_causal(log(spark, sf_dir, "m").where("key != 'signup'"), N_SITES)


@query("conflicts", with_present("m", """
SELECT type, id, key, adds, removes, CASE WHEN adds > 0 AND removes > 0 THEN 'add/remove' WHEN adds > 1 THEN 'add/add' ELSE 'remove/remove' END AS kind
FROM (SELECT type, id, key, count(CASE WHEN op = 'a' THEN 1 END) AS adds, count(CASE WHEN op = 'r' THEN 1 END) AS removes
  FROM cur GROUP BY ALL) WHERE adds + removes > 1"""))
def conflicts(spark, sf_dir):
    return A.conflicts(current(spark, sf_dir, "m"))


# encodings: k = user, v = value
_ENC = """enc AS (SELECT CAST(replace(id, 'm-', '') AS BIGINT) * 10 + length(key) AS k, seq AS v, seq AS tid, site, lts FROM ops)"""
_ENC_CUR = frontier_cte("enc", "cur", ("k",))


def _enc(spark, sf_dir):
    k = F.regexp_replace("id", "m-", "").cast("long") * 10 + F.length("key")
    return log(spark, sf_dir, "m").select(k.alias("k"), F.col("seq").alias("v"), F.col("seq").alias("tid"), "site", "lts")


@query("clock_to_rows", with_log("m", "SELECT k, tid, CAST(s AS INTEGER) AS site, lts[s] AS lts FROM enc, range(1, 4) t(s)", more=_ENC))
def clock_to_rows(spark, sf_dir):
    return E.clock_to_rows(_enc(spark, sf_dir))


@query("rows_to_clock", with_log("m", "SELECT k, tid, CAST(to_json(lts) AS VARCHAR) AS lts FROM enc", more=_ENC))
def rows_to_clock(spark, sf_dir):
    return flat(E.rows_to_clock(E.clock_to_rows(_enc(spark, sf_dir)), N_SITES))


@query("clock_to_json", with_log("m", "SELECT tid, CAST(to_json({'1': lts[1], '2': lts[2], '3': lts[3]}) AS VARCHAR) AS lts FROM enc", more=_ENC))
def clock_to_json(spark, sf_dir):
    return E.encode(_enc(spark, sf_dir), "json", N_SITES).select("tid", "lts")


@query("json_to_clock", with_log("m", "SELECT tid, CAST(to_json(lts) AS VARCHAR) AS lts FROM enc", more=_ENC))
def json_to_clock(spark, sf_dir):
    return flat(E.decode(E.encode(_enc(spark, sf_dir), "json", N_SITES), "json", N_SITES).select("tid", "lts"))


@query("clock_to_box", with_log("m", "SELECT tid, CAST(to_json({'lo': [k, 0, 0, 0], 'hi': [k, lts[1], lts[2], lts[3]]}) AS VARCHAR) AS lts FROM enc", more=_ENC))
def clock_to_box(spark, sf_dir):
    return flat(E.encode(_enc(spark, sf_dir), "box", N_SITES).select("tid", "lts"))


@query("box_to_clock", with_log("m", "SELECT tid, CAST(to_json(lts) AS VARCHAR) AS lts FROM enc", more=_ENC))
def box_to_clock(spark, sf_dir):
    return flat(E.decode(E.encode(_enc(spark, sf_dir), "box", N_SITES), "box", N_SITES).select("tid", "lts"))


@query("box_contains", with_log("m", """
SELECT a.tid, a.lts[1] <= b.lts[1] AND a.lts[2] <= b.lts[2] AND a.lts[3] <= b.lts[3] AS inside
FROM enc a JOIN enc b ON a.k = b.k AND b.tid = a.tid + 40""", more=_ENC))
def box_contains(spark, sf_dir):
    boxes = E.encode(_enc(spark, sf_dir), "box", N_SITES)
    later = boxes.select("k", (F.col("tid") - 40).alias("tid"), F.col("lts").alias("later"))
    return boxes.join(later, ["k", "tid"]).select("tid", E.box_contains("later", "lts", N_SITES).alias("inside"))


for _e in ("array", "json", "box", "rows"):
    def _run(spark, sf_dir, e=_e):
        src = _enc(spark, sf_dir)
        if e == "rows":
            got = E.causal_present_encoded(src.drop("lts"), e, N_SITES, E.clock_to_rows(src), mode="causal")
        else:
            got = E.causal_present_encoded(E.encode(src, e, N_SITES), e, N_SITES, mode="causal")
        return flat(got.select("k", "v", "lts"))

    query(f"causal_present_{_e}", with_log("m", "SELECT k, v, CAST(to_json(lts) AS VARCHAR) AS lts FROM cur", more=f"{_ENC}, {_ENC_CUR}"))(_run)

    def _run(spark, sf_dir, e=_e):
        src = _enc(spark, sf_dir)
        given = E.clock_to_rows(src) if e == "rows" else E.encode(src, e, N_SITES)
        return flat(E.current_clock(given, e, N_SITES))

    query(f"current_clock_{_e}", with_log("m", "SELECT k, CAST(to_json([max(lts[1]), max(lts[2]), max(lts[3])]) AS VARCHAR) AS lts FROM enc GROUP BY k", more=_ENC))(_run)


@query("read_one_key", with_log("m", "SELECT k, v, CAST(to_json(lts) AS VARCHAR) AS lts FROM cur WHERE k = 75", more=f"{_ENC}, {_ENC_CUR}"))
def read_one_key(spark, sf_dir):
    return flat(E.causal_present_encoded(_enc(spark, sf_dir), "array", N_SITES, k=75, mode="causal").select("k", "v", "lts"))


@query("site_clock", with_log("m", "SELECT k, CAST(to_json(arg_max(lts, lts[1] * 1000000000000 + lts[2] * 1000000 + lts[3])) AS VARCHAR) AS lts FROM enc GROUP BY k", more=_ENC))
def site_clock(spark, sf_dir):
    return flat(E.site_clock(_enc(spark, sf_dir), 1))
