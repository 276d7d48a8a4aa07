"""Write-intent queries: the later half of the events become intents against the
present of the earlier half."""

from pyspark.sql import Window, functions as F

from causalog.functions.positions import bulk_positions
from causalog.operators import intents as W, lookup as L
from causalog.operators.merge import merge_ops
from causalog.plans.scan import Running, prefix_scan, row_numbers, sorted_buckets
from causalog.session import stable
from causalog.sources.recipes import N_SITES, epoch_ms, structure_id
from workload.spark_base import flat, log, table
from workload.sql_parts import with_log
from workload.views import _HALF, _LOCAL, _halves

SPARK, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


# Fixed values of the intent recipe: wall clocks jump back so hybrid clocks must hold.
_BACK_MS = 600000
_VERBS = {
    "r": "'register_set'",
    "s": "case when event_type = 'error' then 'set_clear' when value < 20 then 'set_rmv' else 'set_add' end",
    "m": "case when event_type = 'error' then 'map_clear' when value < 20 then 'map_rmv' else 'map_add' end",
    "c": "case when value < 20 then 'counter_dec' else 'counter_inc' end",
    "l": "case event_type when 'error' then 'list_rmv' when 'click' then 'list_pop_first' when 'view' then 'list_pop_last'"
         " when 'signup' then 'list_append' else case when value < 20 then 'list_prepend' else 'list_insert_at' end end",
}


def intents(spark, sf_dir, kind):
    ev = table(spark, sf_dir, "events")
    top = ev.agg(F.floor(F.max("event_id") / 2)).scalar()
    v = F.floor(F.col("value") * 100).cast("long")
    return ev.where(F.col("event_id") > top).select(
        structure_id(kind).alias("id"),
        F.expr(_VERBS[kind]).alias("verb"), F.col("event_type").alias("key"), v.cast("string").alias("value"),
        v.alias("delta"), (v % 40).alias("index"), (1 + F.col("event_id") % N_SITES).cast("int").alias("site"),
        (epoch_ms("ts") - F.col("event_id") % 5 * _BACK_MS).alias("wall_ms"), F.col("event_id").alias("intent_seq"),
    )


def _ints(kind):
    return f"""ints AS (
  SELECT id, {_VERBS[kind]} AS verb, event_type AS key, CAST(v AS VARCHAR) AS value, v AS delta, v % 40 AS index, site,
    pt - event_id % 5 * {_BACK_MS} AS wall_ms, event_id AS seq FROM ops_ev WHERE event_id > {_HALF})"""


def _clears(kind, verb, seen):
    """Removes each clear causes, judged by the last thing the site knew per key."""
    return f"""seen AS ({seen}),
judged AS (
  SELECT c.id, c.site, c.seq, c.wall_ms, k.key,
    (SELECT arg_max(e.verb, e.seq) FROM ints e WHERE e.id = c.id AND e.site = c.site AND e.seq < c.seq
       AND (e.key = k.key OR e.verb = '{verb}_clear')) AS last
  FROM ints c, (SELECT DISTINCT event_type AS key FROM events) k WHERE c.verb = '{verb}_clear'),
cleared AS (
  SELECT j.* FROM judged j LEFT JOIN seen s ON j.id = s.id AND j.key = s.key
  WHERE j.last = '{verb}_add' OR (j.last IS NULL AND s.id IS NOT NULL)),
eff AS (
  SELECT id, key, CASE WHEN verb = '{verb}_add' THEN {"value" if kind == "m" else "CAST(NULL AS VARCHAR)"} END AS data,
    CASE WHEN verb = '{verb}_add' THEN 'a' ELSE 'r' END AS op, site, wall_ms, seq FROM ints WHERE verb <> '{verb}_clear'
  UNION ALL SELECT id, key, NULL, 'r', site, wall_ms, seq FROM cleared)"""


_EFFECTS = {
    "r": "eff AS (SELECT id, '' AS key, value AS data, 'a' AS op, site, wall_ms, seq FROM ints)",
    "s": _clears("s", "set", "SELECT DISTINCT id, key FROM loc WHERE op = 'a'"),
    "m": _clears("m", "map", "SELECT DISTINCT id, key FROM loc WHERE op = 'a'"),
    "c": """eff AS (
  SELECT i.id, CAST(i.site AS VARCHAR) AS key, CAST(CAST(coalesce(b.sub, 0) + sum(CASE WHEN verb = 'counter_inc' THEN delta ELSE -delta END)
    OVER (PARTITION BY i.id, i.site ORDER BY seq) AS BIGINT) AS VARCHAR) AS data, 'a' AS op, i.site, wall_ms, seq
  FROM ints i LEFT JOIN (SELECT id, key, CAST(data AS BIGINT) AS sub FROM loc) b ON i.id = b.id AND CAST(i.site AS VARCHAR) = b.key)""",
}
_STAMP = """evs AS (SELECT DISTINCT id, site, seq, wall_ms FROM eff),
tops AS (SELECT id, max(lts[1]) m1, max(lts[2]) m2, max(lts[3]) m3 FROM loc GROUP BY id),
num AS (
  SELECT e.*, row_number() OVER (PARTITION BY e.id, site ORDER BY seq) AS n,
    row_number() OVER (PARTITION BY site ORDER BY seq) AS pos, max(wall_ms) OVER (PARTITION BY site ORDER BY seq) AS physical,
    wall_ms > coalesce(max(wall_ms) OVER (PARTITION BY site ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS advance,
    coalesce(m1, 0) m1, coalesce(m2, 0) m2, coalesce(m3, 0) m3
  FROM evs e LEFT JOIN tops t ON e.id = t.id),
stamps AS (
  SELECT *, pos - max(CASE WHEN advance THEN pos END) OVER (PARTITION BY site ORDER BY seq) + 1 AS logical,
    [m1 + CASE WHEN site = 1 THEN n ELSE 0 END, m2 + CASE WHEN site = 2 THEN n ELSE 0 END, m3 + CASE WHEN site = 3 THEN n ELSE 0 END] AS lts
  FROM num)"""


def _chain(kind):
    return f"{_LOCAL}, {_ints(kind)}, {_EFFECTS[kind]}, {_STAMP}"


for _name, _kind in (("register_intents", "r"), ("set_intents", "s"), ("map_intents", "m"), ("counter_intents", "c")):
    def _run(spark, sf_dir, kind=_kind):
        local, _ = _halves(spark, sf_dir, kind)
        ops = W.run_intents(intents(spark, sf_dir, kind), local, N_SITES, kinds=(kind,))
        return flat(ops.select("id", "key", "data", "site", "op", "seq", "lts", "pts.physical_time", "pts.logical_time"))

    query(_name, with_log(_kind, """
SELECT e.id, e.key, e.data, e.site, e.op, e.seq, CAST(to_json(s.lts) AS VARCHAR) AS lts,
  s.physical AS physical_time, s.logical AS logical_time
FROM eff e JOIN stamps s ON e.id = s.id AND e.site = s.site AND e.seq = s.seq""", more=_chain(_kind)))(_run)


@query("stamp_lts", with_log("r", "SELECT id, site, seq, CAST(to_json(lts) AS VARCHAR) AS lts FROM stamps", more=_chain("r")))
def stamp_lts(spark, sf_dir):
    local, _ = _halves(spark, sf_dir, "r")
    events = W.events_of(intents(spark, sf_dir, "r"))
    return flat(W.stamp_lts(events, local, N_SITES).select("id", "site", F.col("intent_seq").alias("seq"), "lts"))


_SEED = "seed AS (SELECT site, max(pt) AS p0, CAST(7 AS INTEGER) AS l0 FROM ops_ev WHERE event_id <= " + _HALF + " GROUP BY site)"


_HLC = """held AS (
  SELECT i.site, seq, p0, l0, greatest(p0, max(wall_ms) OVER w) AS physical, row_number() OVER w AS pos,
    wall_ms > greatest(p0, coalesce(max(wall_ms) OVER (PARTITION BY i.site ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS advance
  FROM ints i JOIN seed s ON i.site = s.site WINDOW w AS (PARTITION BY i.site ORDER BY seq)),
runs AS (SELECT *, max(CASE WHEN advance THEN pos END) OVER (PARTITION BY site ORDER BY seq) AS start FROM held)"""


@query("stamp_hlc", with_log("r", """
SELECT site, seq, physical AS physical_time, CASE WHEN start IS NULL THEN l0 + pos ELSE pos - start + 1 END AS logical_time FROM runs""",
    more=f"{_LOCAL}, {_ints('r')}, {_SEED}, {_HLC}"))
def stamp_hlc(spark, sf_dir):
    """Clocks that go on from what each site had seen before the batch."""
    ev = table(spark, sf_dir, "events")
    top = ev.agg(F.floor(F.max("event_id") / 2)).scalar()
    seed = ev.where(F.col("event_id") <= top).groupBy((1 + F.col("event_id") % N_SITES).cast("int").alias("site")).agg(
        F.max(epoch_ms("ts")).alias("physical_time"), F.lit(7).alias("logical_time")
    )
    got = W.stamp_hlc(W.events_of(intents(spark, sf_dir, "r")), seed)
    return got.select("site", F.col("intent_seq").alias("seq"), "pts.physical_time", "pts.logical_time")


@query("merge_intents", with_log("c", """
SELECT id, CAST(sum(CAST(data AS BIGINT)) AS BIGINT) AS data FROM (
  SELECT id, site, arg_max(data, seq) AS data FROM (
    SELECT id, site, data, seq FROM loc UNION ALL SELECT id, site, data, seq + 1000000000000 FROM eff) GROUP BY id, site)
GROUP BY id""", more=_chain("c")))
def merge_intents(spark, sf_dir):
    """Intents run, merged and read back: the counters after the batch."""
    local, _ = _halves(spark, sf_dir, "c")
    ops = W.run_intents(intents(spark, sf_dir, "c"), local, N_SITES, kinds=("c",))
    return L.counter_get_all(merge_ops(local, ops, N_SITES, "causal"))


# lists
_RANKED = "ranked AS (SELECT id, key AS pos, data, row_number() OVER (PARTITION BY id ORDER BY key, site, pt DESC, lt DESC) - 1 AS index FROM loc WHERE op <> 'r'), sizes AS (SELECT id, count(*) AS size FROM ranked GROUP BY id)"
# The edits of every site run one by one: a list holds (old index, or -1 - seq of its insert; old elements before it).
_EDITED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY id, site ORDER BY seq) AS n, verb IN ('list_prepend', 'list_append', 'list_insert_at') AS adds FROM ints),
begun AS (SELECT id, list({'r': index, 'g': index + 1} ORDER BY index) AS state FROM ranked GROUP BY id),
edited(id, site, n, state, seq, hit, gap) AS (
  SELECT DISTINCT i.id, i.site, CAST(0 AS BIGINT), coalesce(b.state, []), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  FROM ints i LEFT JOIN begun b ON i.id = b.id
  UNION ALL
  SELECT id, site, n, CASE WHEN adds THEN state[1:spot] || [{'r': -1 - seq, 'g': gap}] || state[spot + 1:]
      WHEN spot BETWEEN 0 AND len(state) - 1 THEN state[1:spot] || state[spot + 2:] ELSE state END,
    seq, CASE WHEN NOT adds AND spot BETWEEN 0 AND len(state) - 1 THEN state[spot + 1].r END, CASE WHEN adds THEN gap END
  FROM (SELECT *, CASE WHEN spot = 0 THEN 0 ELSE state[spot].g END AS gap FROM (
    SELECT e.id, e.site, i.n, e.state, i.seq, i.adds, CASE i.verb WHEN 'list_prepend' THEN 0 WHEN 'list_append' THEN len(e.state)
        WHEN 'list_insert_at' THEN least(i.index, len(e.state)) WHEN 'list_rmv' THEN i.index WHEN 'list_pop_first' THEN 0 ELSE len(e.state) - 1 END AS spot
    FROM edited e JOIN numbered i ON i.id = e.id AND i.site = e.site AND i.n = e.n + 1)))"""
_LISTS = f"{_LOCAL}, {_ints('l')}, {_RANKED}, {_EDITED}"


def _edited_sql(select):
    return with_log("l", select, more=_LISTS).replace("WITH ", "WITH RECURSIVE ", 1)


@query("list_removes", _edited_sql("""
SELECT e.id, e.site, e.seq, coalesce(r.pos, 'insert ' || (-1 - e.hit)) AS key
FROM edited e LEFT JOIN ranked r ON e.id = r.id AND e.hit = r.index WHERE e.hit IS NOT NULL"""))
def list_removes(spark, sf_dir):
    """What each remove and pop takes: the position of an old element, or the insert of the batch it undoes."""
    local, _ = _halves(spark, sf_dir, "l")
    out = stable(W.list_effects(intents(spark, sf_dir, "l"), local))
    added = out.where("op = 'a'").select("id", "site", "key", F.col("intent_seq").alias("insert"))
    gone = out.where("op = 'r'").join(added, ["id", "site", "key"], "left")
    key = F.coalesce(F.concat(F.lit("insert "), F.col("insert").cast("string")), F.col("key"))
    return gone.select("id", "site", F.col("intent_seq").alias("seq"), key.alias("key"))


@query("list_popped", _edited_sql("""
SELECT i.id, i.site, i.seq, i.verb, coalesce(r.data, b.value) AS data
FROM ints i JOIN edited e ON i.id = e.id AND i.site = e.site AND i.seq = e.seq
LEFT JOIN ranked r ON e.id = r.id AND e.hit = r.index LEFT JOIN ints b ON b.id = e.id AND b.site = e.site AND b.seq = -1 - e.hit
WHERE i.verb IN ('list_pop_first', 'list_pop_last')"""))
def list_popped(spark, sf_dir):
    local, _ = _halves(spark, sf_dir, "l")
    return W.list_popped(intents(spark, sf_dir, "l"), local).withColumnRenamed("intent_seq", "seq")


@query("list_inserts", _edited_sql("""
SELECT i.id, i.site, i.seq, i.value AS data, e.gap FROM numbered i JOIN edited e ON i.id = e.id AND i.site = e.site AND i.seq = e.seq WHERE i.adds"""))
def list_inserts(spark, sf_dir):
    """Where each insert lands: how many of the old elements its position follows."""
    local, _ = _halves(spark, sf_dir, "l")
    new = W.list_effects(intents(spark, sf_dir, "l"), local).where("op = 'a'")
    old = L.list_ranks(local).select("id", F.col("pos").alias("key"), F.lit(1).alias("old"))
    both = new.unionByName(old, allowMissingColumns=True)

    ranged = sorted_buckets(both, ["id", "key"])
    placed = prefix_scan(ranged, ["id"], ["key"], F.col("__range"), {"gap": Running("sum", F.coalesce("old", F.lit(0)).cast("long"))})
    return placed.where("old is null").select("id", "site", F.col("intent_seq").alias("seq"), "data", "gap")


@query("list_edited", _edited_sql("""
SELECT s.id, s.site, s.index, coalesce(r.data, b.value) AS data
FROM (SELECT id, site, unnest(state).r AS r, unnest(range(len(state))) AS index FROM (SELECT id, site, arg_max(state, n) AS state FROM edited GROUP BY id, site)) s
LEFT JOIN ranked r ON s.id = r.id AND s.r = r.index LEFT JOIN ints b ON b.id = s.id AND b.site = s.site AND b.seq = -1 - s.r"""))
def list_edited(spark, sf_dir):
    """Every list as each site that edits it sees it after the batch, in the order of positions."""
    local, _ = _halves(spark, sf_dir, "l")
    out = stable(W.list_effects(intents(spark, sf_dir, "l"), local))
    who = out.select("id", "site").union(intents(spark, sf_dir, "l").select("id", "site")).distinct()
    old = L.list_ranks(local).select("id", F.col("pos").alias("key"), "data").join(who, "id")
    gone = out.where("op = 'r'").select("id", "site", "key")
    live = old.select("id", "site", "key", "data").unionByName(out.where("op = 'a'").select("id", "site", "key", "data")).join(gone, ["id", "site", "key"], "left_anti")
    ranged = sorted_buckets(live, ["id", "site", "key"])
    numbered = row_numbers(ranged, ["id", "site"], ["key"], F.col("__range"), "n", levels=2)
    return numbered.select("id", "site", (F.col("n") - 1).alias("index"), "data")


@query("list_clear", with_log("l", f"""
SELECT s.id, s.key, c.site, c.seq FROM (SELECT id, site, min(seq) AS seq FROM cl GROUP BY id, site) c
JOIN (SELECT id, key FROM loc WHERE op <> 'r') s ON c.id = s.id""",
    more=f"{_LOCAL}, cl AS (SELECT id, site, event_id AS seq FROM ops_ev WHERE event_id > {_HALF} AND event_type = 'error')"))
def list_clear(spark, sf_dir):
    local, _ = _halves(spark, sf_dir, "l")
    clears = intents(spark, sf_dir, "l").where("key = 'error'").withColumn("verb", F.lit("list_clear"))
    return W.effects(clears, local, ("l",)).select("id", "key", "site", F.col("intent_seq").alias("seq"))


# One list per customer, a few elements per market segment letter, in every mode.
for _mode in ("regular", "appends", "prepends"):
    def _run(spark, sf_dir, mode=_mode):
        c = table(spark, sf_dir, "customer")
        size = c.select("c_mktsegment", (F.col("c_custkey") % 300 + 1).alias("n"), "c_custkey")
        lists = size.select(
            F.col("c_custkey").cast("string").alias("id"), F.lit("aZ").alias("lo"),
            F.concat(F.lit("b"), F.substring("c_mktsegment", 1, 1)).alias("hi"), "n", F.lit(1).alias("site"),
        )
        # The next position by a range of ranks: a self-join would take the unexpanded sizes for the
        # number of positions and broadcast them all.
        pos = bulk_positions(lists, mode)
        following = Window.partitionBy("id").orderBy("rank").rangeBetween(1, 1)
        pos = pos.withColumns({"next": F.min("pos").over(following), "later": F.count("*").over(following)})
        here = pos.join(lists.select("id", "lo", "hi"), "id")
        return here.groupBy("id").agg(
            F.sum(F.greatest("later", F.lit(1))).alias("n"),
            F.min((F.col("lo") < F.col("pos")) & (F.col("pos") < F.col("hi")) & F.coalesce(F.col("pos") < F.col("next"), F.lit(True))).alias("ordered"),
            (F.max(F.length("pos")) <= 5).alias("short"),
        )

    query(f"bulk_positions_{_mode}", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 300 + 1 AS n, true AS ordered, true AS short FROM customer")(_run)


# Every order is an inner structure of its customer's map, every customer of a nation's set.
@query("link_integrity", with_log("m", """
SELECT 'cust-' || CAST(o_custkey AS VARCHAR) AS id, 'map_add' AS verb, o_orderpriority AS key, 'ord-' || CAST(o_orderkey AS VARCHAR) AS value, seq
FROM ops JOIN orders ON 'ord-' || CAST(seq AS VARCHAR) = 'ord-' || CAST(o_orderkey AS VARCHAR)
UNION ALL
SELECT 'nation-' || CAST(c_nationkey AS VARCHAR), 'set_add', 'cust-' || CAST(c_custkey AS VARCHAR), NULL, seq
FROM ops JOIN orders ON seq = o_orderkey JOIN customer ON o_custkey = c_custkey"""))
def link_integrity(spark, sf_dir):

    ops = log(spark, sf_dir, "m").withColumn("id", F.concat(F.lit("ord-"), F.col("seq").cast("string")))
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cust = F.concat(F.lit("cust-"), F.col("o_custkey").cast("string"))
    first = o.select(cust.alias("outer_id"), F.col("o_orderpriority").alias("outer_key"),
                     F.concat(F.lit("ord-"), F.col("o_orderkey").cast("string")).alias("inner_id"), F.lit("map_add").alias("add_verb"))
    second = c.select(F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("outer_id"), F.lit(None).cast("string").alias("outer_key"),
                      F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("inner_id"), F.lit("set_add").alias("add_verb"))
    return W.link_integrity(ops, first.unionByName(second)).select("id", "verb", "key", "value", F.col("intent_seq").alias("seq"))
