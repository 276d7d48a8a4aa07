"""Cost curves: sites per clock, nesting depth, one hot element.

    python tools/curves.py SF_DIR

Logs are derived from the events: every user writes registers at ``n`` sites.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from causalog.functions.clocks import hlc  # noqa: E402
from causalog.operators import encodings as E, nested as N  # noqa: E402
from causalog.operators.merge import as_merged  # noqa: E402
from causalog.operators.present import causal_present  # noqa: E402
from causalog.schema import OP  # noqa: E402
from causalog.session import builder, ensure_checkpoint_dir, stable  # noqa: E402
from causalog.sources.ops import generate_nested_ops  # noqa: E402

COPIES = 10


def timed(make):
    """Seconds to build and run; eager steps inside an operator count too."""
    start = time.time()
    df = make()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 2)


def site_log(events, sites, key):
    """A log that repeats every event COPIES times; each site's own coordinate counts up."""
    rows = events.select("event_id", "user_id", "value", F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("c"))
    n = F.col("event_id") * COPIES + F.col("c")
    site = (1 + n % sites).cast("int")
    lts = F.transform(F.sequence(F.lit(1), F.lit(sites)), lambda s: F.when(s == site, n).otherwise(F.floor(n / 4096) * 4096))
    return rows.select(
        key.alias("id"), F.lit("").alias("key"), F.lit("r").alias("type"), F.col("value").cast("string").alias("data"),
        site.alias("site"), lts.alias("lts"), hlc(n, F.lit(1)).alias("pts"), F.lit("a").alias("op"),
        n.alias("seq"), F.lit(0).alias("hops"), n.alias("arrival_time"),
    )


def main():
    sf_dir = sys.argv[1]
    spark = (
        builder("curves").master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/curves"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = {}
    for sites in (1, 3, 8, 16):
        for name, key in (("spread", F.col("user_id").cast("string")), ("one_element", F.lit("hot"))):
            path = f"{root}/{sites}-{name}"
            site_log(events, sites, key).repartition(16).write.parquet(path)
            log = spark.read.schema(OP).parquet(path)
            timed(lambda: log.limit(1))
            out[f"causal_{sites}_sites_{name}"] = timed(lambda: causal_present(log, sites, mode="causal"))
            if sites in (3, 16):
                out[f"exact_{sites}_sites_{name}"] = timed(lambda: causal_present(log, sites, mode="exact"))
    src = spark.read.schema(OP).parquet(f"{root}/16-spread").select("id", F.col("seq").alias("v"), F.col("seq").alias("tid"), "site", "lts")
    src = src.withColumn("k", F.col("id").cast("long")).drop("id")
    for e in ("array", "json", "box", "rows"):
        if e == "rows":
            clocks, given = stable(E.clock_to_rows(src)), stable(src.drop("lts"))
        else:
            clocks, given = None, stable(E.encode(src, e, 16))
        out[f"encoding_{e}_16_sites"] = timed(lambda: E.causal_present_encoded(given, e, 16, clocks, mode="causal"))
    roots = events.select(F.col("event_id").alias("root"))
    for depth in (1, 2, 5, 10):
        present = generate_nested_ops(roots, depth, 3).withColumns({"arrival_time": F.lit(0).cast("long")})
        path = f"{root}/nested-{depth}"
        as_merged(present).write.parquet(path)
        rows = spark.read.parquet(path)
        first = roots.select(F.concat(F.lit("m-"), F.col("root").cast("string"), F.lit("-1")).alias("id"))
        out[f"nested_depth_{depth}"] = timed(lambda: N.nested_json(rows, ["map_aw_lww"] * depth, first))
    out["log_rows"] = events.count() * COPIES
    print(json.dumps(out))


if __name__ == "__main__":
    main()
