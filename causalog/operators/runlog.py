"""Analytics over workload logs: throughput, latency, replication lag, traffic."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalog.plans.scan import Running, prefix_scan
from causalog.session import stable
from causalog.sources.ops import expand_range

LINES_PER_BUCKET = 1 << 20
SECONDS_PER_BUCKET = 1 << 12
BINS = 4096
# A final bin of a percentile holds at most so many values, or equal ones only.
FINAL_ROWS = 100_000
# A group's values meet its bin in this many join keys, so a hot group is dealt to several tasks.
SALTS = 16
RUNNING, RUN_STARTED, COMPLETED, READ = "Running", "Run started", "completed", "read"


def percentile_interp(df: DataFrame, group: list[str], value: str, p: float) -> DataFrame:
    """Percentile with rank r = p/100 * n - 1, interpolated between neighbours.

    NaN for groups of fewer than two values; a rank before the first value means the
    first.  Exact without sorting a group: each round counts values per histogram bin
    (combined map-side) and goes on inside the bin holding the rank, until that bin is
    small or holds one value; every round with different values divides them.
    """
    values = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v"))
    stats = stable(values.groupBy(*group).agg(
        F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")
    ))
    salted = values.withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)))

    def matched(want: DataFrame) -> DataFrame:
        side = want.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).alias("w")
        hit = [F.col(f"v.{g}").eqNullSafe(F.col(f"w.{g}")) for g in [*group, "__salt"]]
        inside = F.col("v.__v").between(F.col("w.__lo"), F.col("w.__hi"))
        return salted.alias("v").join(side, [*hit, inside]).select("w.*", "v.__v").drop("__salt")

    rank = F.greatest(F.lit(p / 100.0) * F.col("__n") - 1, F.lit(0.0))
    head = stats.withColumn("__r", rank).withColumn("__base", F.floor("__r"))
    want = head.where("__n > 1").select(
        *group, "__lo", "__hi", F.explode(F.array(F.lit(0), F.lit(1))).alias("__t"), "__base", "__n"
    ).withColumn("__k", F.least(F.col("__base") + F.col("__t"), F.col("__n") - 1)).drop("__base", "__n")

    slot = [*group, "__t"]
    large = True
    while large:
        span = F.col("__hi") - F.col("__lo")
        bin_ = F.when(span > 0, F.least(F.floor((F.col("__v") - F.col("__lo")) / span * BINS), F.lit(BINS - 1))).otherwise(0)
        bins = matched(want).groupBy(*slot, "__k", bin_.alias("__bin")).agg(
            F.count("*").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")
        )
        want = stable(_holding_rank(bins, slot, "__bin"))
        large = not want.where((F.col("__c") > FINAL_ROWS) & (F.col("__lo") < F.col("__hi"))).isEmpty()
        want = want.drop("__c", "__before", "__bin")
    single = matched(want).groupBy(*slot, "__k", "__v").agg(F.count("*").alias("__c"))
    found = _holding_rank(single, slot, "__v").groupBy(*group).agg(
        F.max(F.when(F.col("__t") == 0, F.col("__v"))).alias("__a"), F.max(F.when(F.col("__t") == 1, F.col("__v"))).alias("__b")
    )
    joined = head.alias("h").join(found.alias("f"), [F.col(f"h.{g}").eqNullSafe(F.col(f"f.{g}")) for g in group], "left")
    part = F.col("__r") - F.col("__base")
    result = F.when(F.col("__n") <= 1, F.lit(float("nan"))).otherwise(F.col("__a") + part * (F.col("__b") - F.col("__a")))
    return joined.select(*[F.col(f"h.{g}").alias(g) for g in group], result.alias("percentile"))


def _holding_rank(bins: DataFrame, slot: list[str], order: str) -> DataFrame:
    """The bin that holds rank __k (from zero), with the rank inside it."""
    before = Window.partitionBy(*slot).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = bins.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    rows = rows.where((F.col("__before") <= F.col("__k")) & (F.col("__k") < F.col("__before") + F.col("__c")))
    return rows.withColumn("__k", F.col("__k") - F.col("__before"))


def measured(ops: DataFrame, duration: float, warmup: float, cooldown: float, elapsed: str = "elapsed") -> DataFrame:
    """Operations outside the warm-up and cool-down of a timed run."""
    return ops.where((F.col(elapsed) > warmup) & (F.col(elapsed) < duration - cooldown))


def op_summary(ops: DataFrame, seconds: Column, p: float = 95) -> DataFrame:
    """Means over runs per operation, and over all operations as ``total``.

    ``ops`` is (run, worker, operation, rt, aborted); ``seconds`` is each worker's
    measured time, so throughput adds up over workers.  Response times count completed
    operations only.
    """
    done = F.when(~F.col("aborted"), F.col("rt"))
    per_operation = ops.withColumn("__s", seconds).groupBy("run", "worker", "operation").agg(
        F.count(done).alias("ct"), F.sum(done).alias("sum"), F.count(F.when(F.col("aborted"), 1)).alias("aborts"), F.max("__s").alias("__s")
    )
    per_worker = per_operation.withColumn("name", F.explode(F.array("operation", F.lit("total")))).groupBy("run", "worker", "name").agg(
        F.sum("ct").alias("ct"), F.sum("sum").alias("sum"), F.sum("aborts").alias("aborts"), (F.sum("ct") / F.max("__s")).alias("tps")
    )
    per_run = per_worker.groupBy("run", "name").agg(
        F.sum("ct").alias("ct"), F.sum("sum").alias("sum"), F.sum("aborts").alias("aborts"), F.sum("tps").alias("tps")
    )
    completed = ops.where(~F.col("aborted"))
    tail = percentile_interp(completed.withColumnRenamed("operation", "name"), ["run", "name"], "rt", p).unionByName(
        percentile_interp(completed, ["run"], "rt", p).withColumn("name", F.lit("total"))
    )
    nan = F.lit(float("nan"))
    rows = per_run.join(tail, ["run", "name"], "left").select(
        "name", F.when(F.col("ct") > 0, F.col("sum") / F.col("ct")).otherwise(nan).alias("rt"), "tps",
        F.col("ct").cast("double").alias("ct"), (F.col("aborts") / (F.col("aborts") + F.col("ct"))).alias("ar"),
        F.coalesce("percentile", nan).alias("p"),
    )
    return rows.groupBy("name").agg(*[F.avg(c).alias(c) for c in ("rt", "tps", "ct", "ar")], F.avg("p").alias(f"rt_p{p:g}"))


def _seconds(column: str) -> Column:
    return F.unix_micros(F.try_to_timestamp(column)) / F.lit(1_000_000.0)


def _bucketed(seconds: Column, width: float) -> Column:
    return F.floor(seconds / width) * F.lit(float(width)) if width else seconds


def _first_start(log: DataFrame) -> Column:
    """When the first worker began, as a scalar subquery."""
    return log.where(F.col("message") == RUNNING).agg(F.min_by(_seconds("time"), F.col("line"))).scalar()


def rt_over_time(log: DataFrame, bucket: float, group: str | None = None) -> DataFrame:
    """Mean response time in ms per operation (and group) and time bucket."""
    rows = log.where("operation is not null").withColumns({
        "x": _bucketed(_seconds("real_time") - _first_start(log), bucket), "y": F.col("rt") * 1000,
    })
    keys = ["operation", *([group] if group else []), "x"]
    return rows.groupBy(*keys).agg(F.avg("y").alias("rt_ms"))


def with_run_state(log: DataFrame) -> DataFrame:
    """Add what the log said so far: run number, its workers, last start of the workers."""
    started, running = F.col("message") == RUN_STARTED, F.col("message") == RUNNING
    return prefix_scan(
        log, [], ["line"], F.floor(F.col("line") / LINES_PER_BUCKET),
        {
            "run": Running("sum", started.cast("long")),
            "run_workers": Running("last", F.when(started, F.col("workers"))),
            "begin": Running("last", F.when(running, _seconds("time"))),
        },
    )


def _reported(log: DataFrame, message: str, site: int | None) -> DataFrame:
    """Lines of one message after the workers' first start, with the run state; other lines are dropped first."""
    wanted = F.col("message") == message
    if site is not None:
        wanted &= F.col("connId") == site
    used = log.where(wanted | F.col("message").isin(RUNNING, RUN_STARTED)).select(
        "line", "message", "time", "workers", "connId", "delay", "count"
    )
    return with_run_state(used).where((F.col("message") == message) & F.col("begin").isNotNull())


def lag_over_time(log: DataFrame, main_worker: int = 0, bucket: float = 1) -> DataFrame:
    """Replication lag and throughput per (workers, time bucket).

    A read by the main worker is compared with the largest value any other worker had
    reported before for each counter; a bucket without such reads carries the previous
    lag on.
    """
    used = log.where(F.col("message").isin(RUNNING, RUN_STARTED, COMPLETED, READ)).select(
        "line", "message", "time", "real_time", "worker", "workers", "totalCounters", "counters"
    )
    state = stable(with_run_state(used).withColumn("workers", F.coalesce("run_workers", F.lit(0))))
    begin = _first_start(log)
    reads = state.where(F.col("message") == READ)
    main = reads.where(F.col("worker") == main_worker).select(
        "run", "line", "workers", "totalCounters", "counters", _bucketed(_seconds("time") - begin, bucket).alias("time")
    )
    behind = _behind(main, reads.where(F.col("worker") != main_worker))
    delays = main.join(behind, ["run", "line"], "left").select(
        "workers", "time", F.coalesce(F.col("__sum") * F.col("totalCounters") / F.col("__keys"), F.lit(0.0)).alias("delay"),
        F.lit(1).alias("reads"), F.lit(0).alias("done"),
    )
    completed = state.where(F.col("message") == COMPLETED).select(
        "workers", _bucketed(_seconds("real_time") - begin, bucket).alias("time"),
        F.lit(0.0).alias("delay"), F.lit(0).alias("reads"), F.lit(1).alias("done"),
    )
    points = stable(delays.unionByName(completed).groupBy("workers", "time").agg(
        F.sum("delay").alias("delay"), F.sum("reads").alias("reads"), F.sum("done").alias("done")
    ))
    carried = prefix_scan(
        points, [], ["workers", "time"],
        F.col("workers") * F.lit(2**32) + F.floor(F.col("time") / SECONDS_PER_BUCKET),
        {"lag": Running("last", F.when(F.col("reads") > 0, F.col("delay") / F.col("reads")))},
    )
    tps = F.col("done") / F.lit(float(bucket)) if bucket else F.lit(None).cast("double")
    return carried.select("time", "workers", F.coalesce("lag", F.lit(0.0)).alias("delay"), tps.alias("tps"))


def _behind(main: DataFrame, others: DataFrame) -> DataFrame:
    """(run, line, __sum, __keys): by how much a main read lags, over the counters known before it.

    A counter that a read does not name counts with its whole largest value.  So the sum
    is one running total of all counters' largest values, corrected for the few counters
    the read names; no row is made per read and known counter.
    """
    def named(rows: DataFrame, value: str) -> DataFrame:
        return rows.select("run", "line", F.explode("counters").alias("key", value))

    bucket = F.floor(F.col("line") / LINES_PER_BUCKET)
    known = stable(prefix_scan(
        named(main, "own").unionByName(named(others, "value"), allowMissingColumns=True), ["run", "key"], ["line"], bucket,
        {"latest": Running("max", F.when(F.col("value").isNotNull(), F.greatest(F.col("value"), F.lit(0))), inclusive=False)}, levels=2,
    ))
    grown = known.where("value is not null and (latest is null or value > latest)").groupBy("run", "line").agg(
        F.sum(F.greatest(F.col("value"), F.lit(0)) - F.coalesce("latest", F.lit(0))).alias("grown"),
        F.count(F.when(F.col("latest").isNull(), 1)).alias("new"),
    )
    less = known.where("own is not null and latest is not null").groupBy("run", "line").agg(
        F.sum(F.greatest(F.col("latest") - F.col("own"), F.lit(0)) - F.col("latest")).alias("less")
    )
    asked = main.select("run", "line").join(less, ["run", "line"], "left").withColumn("asked", F.lit(True))
    return prefix_scan(
        asked.unionByName(grown, allowMissingColumns=True), ["run"], ["line"], bucket,
        {"all": Running("sum", F.col("grown")), "__keys": Running("sum", F.col("new"))}, levels=2,
    ).where("asked and __keys > 0").select("run", "line", (F.col("all") + F.coalesce("less", F.lit(0))).alias("__sum"), "__keys")


def delay_over_time(log: DataFrame, bucket: float = 1, site: int | None = None) -> DataFrame:
    """Mean reported delay per site, number of workers and time bucket."""
    rows = _reported(log, "delay", site)
    at = (F.col("__x") / bucket).cast("long") * F.lit(float(bucket))
    rows = rows.withColumn("__x", _seconds("time") - F.col("begin"))
    return rows.groupBy(
        F.col("connId").alias("site"), F.coalesce("run_workers", F.lit(0)).alias("workers"), at.alias("time")
    ).agg(F.avg("delay").alias("delay"))


def backlog_over_time(log: DataFrame, site: int | None = None) -> DataFrame:
    """Reported unmerged rows per site over time."""
    rows = _reported(log, "Unmerged rows", site)
    return rows.select(F.col("connId").alias("site"), (_seconds("time") - F.col("begin")).alias("time"), "count")


def traffic_per_second(packets: DataFrame, self_ip: str) -> DataFrame:
    """Bytes and packets per second and peer; idle seconds appear once with peer ``-``."""
    begin = packets.agg(F.min("time")).scalar()
    sent = F.col("src") == self_ip
    size = F.col("length")
    busy = packets.groupBy(
        F.floor(F.col("time") - begin).alias("time"), F.when(sent, F.col("dst")).otherwise(F.col("src")).alias("ip")
    ).agg(
        F.coalesce(F.sum(F.when(sent, size)), F.lit(0)).alias("bytes_sent"),
        F.coalesce(F.sum(F.when(~sent, size)), F.lit(0)).alias("bytes_recv"),
        F.count(F.when(sent, 1)).alias("packets_sent"),
        F.count(F.when(~sent, 1)).alias("packets_recv"),
    )
    last = busy.agg(F.max("time").alias("n")).where("n is not null").select(F.lit(0).alias("capture"), (F.col("n") + 1).alias("n"))
    seconds = expand_range(last, "n", "time", ["capture"]).select("time")
    idle = seconds.join(busy.select("time").distinct(), "time", "left_anti").select(
        "time", F.lit("-").alias("ip"),
        *[F.lit(0).cast("long").alias(c) for c in ("bytes_sent", "bytes_recv", "packets_sent", "packets_recv")],
    )
    return busy.unionByName(idle)


def traffic_totals(traffic: DataFrame, after: float, tags: list[str]) -> DataFrame:
    """Bytes per tag group, overall (``ip`` NULL) and per peer, after the set-up time."""
    late = traffic.where(F.col("time") > after)
    sums = [F.sum(c).alias(c) for c in ("bytes_sent", "bytes_recv")]
    columns = [F.col(c) for c in [*tags, "ip"]]
    rows = late.groupingSets([columns[:-1], columns], *columns).agg(*sums)
    return rows.withColumn("total", F.col("bytes_sent") + F.col("bytes_recv"))


def derive(df: DataFrame, x: str, y: str, group: str = "''", where: str | None = None) -> DataFrame:
    """Columns _X, _Y and _G from SQL expressions over results, sorted by _X."""
    rows = df.where(where) if where else df
    return rows.withColumns({"_X": F.expr(x), "_Y": F.expr(y), "_G": F.expr(group)}).orderBy("_X")


def pivot_mean(df: DataFrame, x: str, group: str, y: str, groups: list | None = None) -> DataFrame:
    """Mean of y for every (x, group) pair; pairs without rows get 0.

    The result has one row per pair by definition.  It is made in long form, so there
    may be any number of groups; ``groups`` names those wanted.
    """
    found = df.groupBy(F.col(x).alias("__x"), F.col(group).cast("string").alias("__g")).agg(F.avg(y).alias("__y"))
    if groups is None:
        wanted = df.select(F.col(group).cast("string").alias(group)).distinct()
    else:
        wanted = df.sparkSession.createDataFrame([(str(g),) for g in groups], f"`{group}` string")
    pairs = df.select(x).distinct().crossJoin(wanted)
    hit = F.col(x).eqNullSafe(F.col("__x")) & F.col(group).eqNullSafe(F.col("__g"))
    return pairs.join(found, hit, "left").select(x, group, F.coalesce("__y", F.lit(0.0)).alias(y))


def band(df: DataFrame, x: str, y: str) -> DataFrame:
    """Lowest and highest y per x."""
    return df.groupBy(x).agg(F.min(y).alias("low"), F.max(y).alias("high"))


# The phases of a read and the wide columns holding their mean and tail.
PHASES = {
    "plan": ("planTime", "planP95"), "exec": ("execTime", "execP95"),
    "plan + exec": ("totalTime", "totalP95"), "real": ("rt", "rtP95"),
}


def phase_times(results: DataFrame, key: str = "nestingLevel") -> DataFrame:
    """One row per phase from one wide row per configuration."""
    phases = [
        F.struct(F.lit(name).alias("type"), F.col(mean).cast("double").alias("time"), F.col(tail).cast("double").alias("p95"))
        for name, (mean, tail) in PHASES.items()
    ]
    return results.select(key, F.inline(F.array(*phases)))
