"""Workload-log queries over logs whose lines are derived from the events."""

from pyspark.sql import functions as F

from causalog.operators import runlog as T
from causalog.session import ensure_checkpoint_dir
from causalog.sources import logs as S
from workload.spark_base import folder, table

SPARK, SQL = {}, {}
DAY = 86400


def query(name, sql=None):
    def register(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def _json(**fields):
    """JSON text of already rendered values."""
    parts = [F.lit("{")]
    for i, (name, value) in enumerate(fields.items()):
        parts += [F.lit(f'{", " if i else ""}"{name}": '), value]
    return F.concat(*parts, F.lit("}"))


def _str(col):
    return F.concat(F.lit('"'), col, F.lit('"'))


def lines(spark, sf_dir):
    """(line, value): four line numbers per event, of which up to four are used."""
    e = table(spark, sf_dir, "events")
    t = _str(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    v = F.floor(F.col("value") * 100).cast("string")
    n = F.col("event_id")

    def num(c):
        return c.cast("string")

    def line(at, text, where=None):
        rows = e.where(where) if where is not None else e
        return rows.select((n * 4 + at).alias("line"), text.alias("value"))

    user = F.col("user_id")
    reads = F.concat(
        F.lit('{"time": '), t, F.lit(', "message": "read", "worker": '), num(user % 4), F.lit(', "totalCounters": 16, "_c-'),
        num(user % 5), F.lit('": '), num(n), F.lit(', "_c-'), num(5 + user % 3), F.lit('": '), v, F.lit("}"),
    )
    site = num(user % 3)
    return (
        line(0, _json(time=t, message=_str(F.lit("Running"))), "event_id = 0")
        .unionByName(line(1, _json(time=t, message=_str(F.lit("Run started")), workers=num(1 + n % 3)), "get_json_object(props, '$.k') = '7'"))
        .unionByName(line(2, _json(time=t, message=_str(F.lit("completed")), worker=num(user % 8), operation=_str(F.col("event_type")),
                                   rt=num(F.col("value") / 1000), real_time=t)))
        .unionByName(line(3, reads, "event_type = 'view'"))
        .unionByName(line(3, _json(time=t, message=_str(F.lit("delay")), connId=site, delay=v), "event_type = 'click'"))
        .unionByName(line(3, _json(time=t, message=_str(F.lit("Unmerged rows")), connId=site, count=v), "event_type = 'signup'"))
        .unionByName(line(3, F.lit("panic: {not json"), "event_type = 'error'"))
    )


def run_log(spark, sf_dir):
    """The log as files in line order, read back; every line keeps its place, not its number."""
    path = folder(spark, "run-log")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines(spark, sf_dir).repartitionByRange(parts, "line").sortWithinPartitions("line").select("value").write.text(path)
    return S.read_run_log(spark, path)


_LOG = f"""ev AS (SELECT *, epoch_us(ts) / 1000000.0 AS sec, CAST(floor(value * 100) AS BIGINT) AS v,
    json_extract_string(props, '$.k') = '7' AS starts FROM events),
base AS (SELECT min(sec) AS b FROM ev WHERE event_id = 0),
st AS (SELECT ev.*, CAST(sec AS DOUBLE) - CAST(b AS DOUBLE) AS x, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS run,
  coalesce(last_value(CASE WHEN starts THEN 1 + event_id % 3 END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS workers
  FROM ev, base)"""


@query("read_run_log", """
SELECT line, message, operation, worker, rt FROM (SELECT * REPLACE (row_number() OVER (ORDER BY line) AS line) FROM (
SELECT event_id * 4 + 2 AS line, 'completed' AS message, event_type AS operation, CAST(user_id % 8 AS INTEGER) AS worker, round(value / 1000, 9) AS rt FROM events
UNION ALL SELECT event_id * 4 + 3, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'delay' ELSE 'Unmerged rows' END, NULL,
  CASE WHEN event_type = 'view' THEN CAST(user_id % 4 AS INTEGER) END, NULL FROM events WHERE event_type IN ('view', 'click', 'signup')
UNION ALL SELECT event_id * 4 + 1, 'Run started', NULL, NULL, NULL FROM events WHERE json_extract_string(props, '$.k') = '7'
UNION ALL SELECT event_id * 4, 'Running', NULL, NULL, NULL FROM events WHERE event_id = 0
UNION ALL SELECT event_id * 4 + 3, NULL, NULL, NULL, NULL FROM events WHERE event_type = 'error')) WHERE message IS NOT NULL""")
def read_run_log(spark, sf_dir):
    """Broken lines (one per error event) are skipped."""
    return run_log(spark, sf_dir).select("line", "message", "operation", "worker", F.round("rt", 9).alias("rt"))


@query("rt_over_time", f"""WITH {_LOG}
SELECT event_type AS operation, floor(x / {DAY}) * {DAY} AS x, round(avg(value), 6) AS rt_ms FROM st GROUP BY ALL""")
def rt_over_time(spark, sf_dir):
    return T.rt_over_time(run_log(spark, sf_dir), DAY).withColumn("rt_ms", F.round("rt_ms", 6))


@query("rt_over_time_grouped", f"""WITH {_LOG}
SELECT event_type AS operation, CAST(user_id % 8 AS INTEGER) AS worker, floor(x / {DAY}) * {DAY} AS x, round(avg(value), 6) AS rt_ms FROM st GROUP BY ALL""")
def rt_over_time_grouped(spark, sf_dir):
    return T.rt_over_time(run_log(spark, sf_dir), DAY, "worker").withColumn("rt_ms", F.round("rt_ms", 6))


@query("lag_over_time", f"""WITH {_LOG},
rd AS (SELECT run, workers, event_id AS line, user_id % 4 AS worker, floor(x / 3600) * 3600 AS time,
  '_c-' || CAST(user_id % 5 AS VARCHAR) AS k1, event_id AS v1, '_c-' || CAST(5 + user_id % 3 AS VARCHAR) AS k2, v AS v2 FROM st WHERE event_type = 'view'),
oth AS (SELECT run, line, k1 AS key, v1 AS val FROM rd WHERE worker <> 0 UNION ALL SELECT run, line, k2, v2 FROM rd WHERE worker <> 0),
pairs AS (SELECT m.run, m.line, o.key, max(o.val) AS latest,
    any_value(CASE WHEN o.key = m.k1 THEN m.v1 WHEN o.key = m.k2 THEN m.v2 ELSE 0 END) AS own
  FROM rd m JOIN oth o ON m.run = o.run AND o.line < m.line WHERE m.worker = 0 GROUP BY m.run, m.line, o.key),
lag AS (SELECT run, line, CAST(sum(greatest(latest - own, 0)) * 16 AS DOUBLE) / count(*) AS d FROM pairs GROUP BY ALL),
pts AS (
  SELECT workers, time, coalesce(d, 0) AS d, 1 AS reads, 0 AS done FROM rd LEFT JOIN lag USING (run, line) WHERE worker = 0
  UNION ALL SELECT workers, floor(x / 3600) * 3600, 0, 0, 1 FROM st),
agg AS (SELECT workers, time, sum(d) AS d, sum(reads) AS reads, sum(done) AS done FROM pts GROUP BY ALL)
SELECT time, CAST(workers AS INTEGER) AS workers, round(coalesce(last_value(CASE WHEN reads > 0 THEN d / reads END IGNORE NULLS)
  OVER (ORDER BY workers, time ROWS UNBOUNDED PRECEDING), 0), 4) AS delay, round(done / 3600.0, 6) AS tps FROM agg""")
def lag_over_time(spark, sf_dir):
    got = T.lag_over_time(run_log(spark, sf_dir), 0, 3600)
    return got.withColumns({"delay": F.round("delay", 4), "tps": F.round("tps", 6)})


@query("delay_over_time", f"""WITH {_LOG}
SELECT CAST(user_id % 3 AS INTEGER) AS site, CAST(workers AS INTEGER) AS workers, CAST(floor(x / {DAY}) * {DAY} AS DOUBLE) AS time, round(avg(v), 6) AS delay
FROM st WHERE event_type = 'click' GROUP BY ALL""")
def delay_over_time(spark, sf_dir):
    return T.delay_over_time(run_log(spark, sf_dir), DAY).withColumn("delay", F.round("delay", 6))


@query("backlog_over_time", f"""WITH {_LOG}
SELECT CAST(user_id % 3 AS INTEGER) AS site, round(x, 3) AS time, v AS count FROM st WHERE event_type = 'signup'""")
def backlog_over_time(spark, sf_dir):
    return T.backlog_over_time(run_log(spark, sf_dir)).withColumn("time", F.round("time", 3))


def _operations(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).alias("run"), (F.col("user_id") % 8).alias("worker"), F.col("event_type").alias("operation"),
        F.col("value").alias("rt"), (F.col("value") < 5).alias("aborted"), F.col("value").alias("elapsed"),
    )


_P95 = """CASE WHEN n <= 1 THEN 'NaN'::DOUBLE ELSE a[CAST(floor(r) AS BIGINT) + 1] + (r - floor(r)) *
  (coalesce(a[CAST(floor(r) AS BIGINT) + 2], a[CAST(floor(r) AS BIGINT) + 1]) - a[CAST(floor(r) AS BIGINT) + 1]) END"""


@query("op_summary", f"""
WITH o AS (SELECT user_id % 3 AS run, user_id % 8 AS worker, event_type AS name, value AS rt, value < 5 AS ab FROM events
  UNION ALL SELECT user_id % 3, user_id % 8, 'total', value, value < 5 FROM events),
w AS (SELECT run, worker, name, count(*) FILTER (NOT ab) AS ct, sum(rt) FILTER (NOT ab) AS s, count(*) FILTER (ab) AS ac,
  count(*) FILTER (NOT ab) / (50.0 + worker) AS tps FROM o GROUP BY run, worker, name),
per_run AS (SELECT run, name, sum(ct) AS ct, sum(s) AS s, sum(ac) AS ac, sum(tps) AS tps FROM w GROUP BY ALL),
q AS (SELECT run, name, list(rt ORDER BY rt) AS a, count(*) AS n, greatest(CAST(0.95 AS DOUBLE) * count(*) - 1, 0) AS r FROM o WHERE NOT ab GROUP BY ALL)
SELECT name, round(avg(s / ct), 6) AS rt, round(avg(tps), 6) AS tps, round(avg(ct), 6) AS ct, round(avg(ac / (ac + ct)), 6) AS ar, round(avg({_P95}), 6) AS rt_p95
FROM per_run JOIN q USING (run, name) GROUP BY name""")
def op_summary(spark, sf_dir):
    got = T.op_summary(_operations(spark, sf_dir), F.lit(50.0) + F.col("worker"))
    return got.select("name", *[F.round(c, 6).alias(c) for c in ("rt", "tps", "ct", "ar", "rt_p95")])


@query("measured", "SELECT event_type AS operation, count(*) AS n FROM events WHERE value > 3 AND value < 57 GROUP BY ALL")
def measured(spark, sf_dir):
    return T.measured(_operations(spark, sf_dir), 60, 3, 3).groupBy("operation").agg(F.count("*").alias("n"))


for _p in (50, 95, 99):
    def _run(spark, sf_dir, p=_p):
        li = table(spark, sf_dir, "lineitem")
        return T.percentile_interp(li, ["l_returnflag"], "l_extendedprice", p).withColumn("percentile", F.round("percentile", 6))

    query(f"percentile_interp_{_p}", f"""
WITH q AS (SELECT l_returnflag, list(l_extendedprice ORDER BY l_extendedprice) AS a, count(*) AS n,
  greatest(CAST({_p / 100} AS DOUBLE) * count(*) - 1, 0) AS r FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round({_P95}, 6) AS percentile FROM q""")(_run)


def packet_lines(spark, sf_dir):
    n, user = F.col("event_id"), F.col("user_id")
    seconds = F.concat(F.floor(n * 5 / 2).cast("string"), F.when(n % 2 == 1, ".500000").otherwise(".000000"))
    text = F.concat(
        seconds, F.lit(" IP 10.0.0."), (user % 3).cast("string"), F.lit(".5432 > 10.0.0."), (3 + n % 3).cast("string"),
        F.lit(".4000: tcp "), F.floor(F.col("value") * 100).cast("string"),
    )
    broken = F.concat(seconds, F.lit(" ARP, Request who-has 10.0.0.9"))
    return table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", broken).otherwise(text).alias("value"))


def packets(spark, sf_dir):
    path = folder(spark, "packets")
    packet_lines(spark, sf_dir).write.text(path)
    return S.read_packets(spark, path)


_PACKETS = """pk AS (SELECT event_id * 5 / 2.0 AS time, '10.0.0.' || CAST(user_id % 3 AS VARCHAR) AS src,
  '10.0.0.' || CAST(3 + event_id % 3 AS VARCHAR) AS dst, CAST(floor(value * 100) AS BIGINT) AS length FROM events WHERE event_type <> 'error'),
raw AS (SELECT CAST(floor(time - (SELECT min(time) FROM pk)) AS BIGINT) AS time, CASE WHEN src = '10.0.0.1' THEN dst ELSE src END AS ip,
  src = '10.0.0.1' AS sent, length FROM pk),
busy AS (SELECT time, ip, CAST(coalesce(sum(length) FILTER (sent), 0) AS BIGINT) AS bytes_sent, CAST(coalesce(sum(length) FILTER (NOT sent), 0) AS BIGINT) AS bytes_recv,
  count(*) FILTER (sent) AS packets_sent, count(*) FILTER (NOT sent) AS packets_recv FROM raw GROUP BY ALL),
traffic AS (SELECT * FROM busy UNION ALL
  SELECT t, '-', 0, 0, 0, 0 FROM range((SELECT max(time) + 1 FROM busy)) r(t) WHERE t NOT IN (SELECT time FROM busy))"""


@query("read_packets", f"WITH {_PACKETS} SELECT CAST(time AS DOUBLE) AS time, src, dst, length FROM pk")
def read_packets(spark, sf_dir):
    return packets(spark, sf_dir)


@query("traffic_per_second", f"WITH {_PACKETS} SELECT * FROM traffic")
def traffic_per_second(spark, sf_dir):
    return T.traffic_per_second(packets(spark, sf_dir), "10.0.0.1")


@query("traffic_totals", f"""WITH {_PACKETS}
SELECT 'e' AS engine, CAST(time // 3600 AS VARCHAR) AS name, ip, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent, CAST(sum(bytes_recv) AS BIGINT) AS bytes_recv,
  CAST(sum(bytes_sent) + sum(bytes_recv) AS BIGINT) AS total FROM traffic WHERE time > 100 GROUP BY GROUPING SETS ((time // 3600), (time // 3600, ip))""")
def traffic_totals(spark, sf_dir):
    tagged = T.traffic_per_second(packets(spark, sf_dir), "10.0.0.1").withColumns(
        {"engine": F.lit("e"), "name": F.floor(F.col("time") / 3600).cast("string")})
    return T.traffic_totals(tagged, 100, ["engine", "name"])


@query("derive", "SELECT event_id, value * 2 AS _X, value + user_id AS _Y, event_type || '-' || CAST(user_id AS VARCHAR) AS _G FROM events WHERE value > 50")
def derive(spark, sf_dir):
    got = T.derive(table(spark, sf_dir, "events"), "value * 2", "value + user_id", "event_type || '-' || user_id", "value > 50")
    return got.select("event_id", "_X", "_Y", "_G")


@query("pivot_mean", """
SELECT x.user_id, g.event_type, coalesce(round(avg(value), 6), 0) AS value
FROM (SELECT DISTINCT user_id FROM events) x CROSS JOIN (SELECT DISTINCT event_type FROM events) g
LEFT JOIN events e ON e.user_id = x.user_id AND e.event_type = g.event_type GROUP BY ALL""")
def pivot_mean(spark, sf_dir):
    return T.pivot_mean(table(spark, sf_dir, "events"), "user_id", "event_type", "value").withColumn("value", F.round("value", 6))


@query("band", "SELECT o_orderpriority, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY ALL")
def band(spark, sf_dir):
    return T.band(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@query("phase_times", """
WITH w AS (SELECT p_size AS nestingLevel, min(p_retailprice) AS a, max(p_retailprice) AS b, CAST(count(*) AS DOUBLE) AS c FROM part GROUP BY ALL)
SELECT nestingLevel, 'plan' AS type, a AS time, b AS p95 FROM w UNION ALL SELECT nestingLevel, 'exec', b, c FROM w
UNION ALL SELECT nestingLevel, 'plan + exec', c, a FROM w UNION ALL SELECT nestingLevel, 'real', a, c FROM w""")
def phase_times(spark, sf_dir):
    low, high, n = F.min("p_retailprice"), F.max("p_retailprice"), F.count("*")
    wide = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("nestingLevel")).agg(
        low.alias("planTime"), high.alias("planP95"), high.alias("execTime"), n.alias("execP95"),
        n.alias("totalTime"), low.alias("totalP95"), low.alias("rt"), n.alias("rtP95"))
    return T.phase_times(wide)


@query("read_results", """
SELECT name, tps, extra, stem LIKE 'part-%' AS from_part FROM (SELECT s_name AS name, s_acctbal AS tps, NULL AS extra, 'part-s' AS stem FROM supplier
UNION ALL SELECT c_name, c_acctbal, c_mktsegment, 'part-c' FROM customer)""")
def read_results(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/results-{spark.sparkContext.applicationId}"
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    s.selectExpr("s_name as name", "s_acctbal as tps").write.mode("overwrite").csv(f"{out}/a", header=True)
    c.selectExpr("c_mktsegment as extra", "c_name as name", "c_acctbal as tps").write.mode("overwrite").csv(f"{out}/b", header=True)
    found = S.read_results(spark, [f"{out}/a", f"{out}/b"], ("tps",))
    return found.withColumn("from_part", F.col("_file").rlike("^part-[^./]+$")).drop("_file")
