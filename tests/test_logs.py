import json
import math
import random

import pytest
from pyspark.sql import functions as F

from causalog.operators import runlog as T
from causalog.plans.scan import Running, prefix_scan, row_numbers, sorted_buckets
from causalog.sources import logs as S
from causalog.sources.ops import clone_structure, generate_nested_ops, generate_ops
from tests.helpers import N, op, present, rows


def test_prefix_scan_equals_one_window(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), i, rng.choice([None, rng.randrange(50)])) for i in range(200)]
    df = spark.createDataFrame(data, "g string, o bigint, v bigint")
    for levels, reverse in ((1, False), (2, False), (1, True), (3, True)):
        got = prefix_scan(df, ["g"], ["o"], F.floor(F.col("o") / 7), {
            "s": Running("sum", F.col("v")), "m": Running("max", F.col("v"), False), "n": Running("min", F.col("v"), False),
            "l": Running("last", F.col("v"), False),
        }, reverse, levels)
        have = {(r["g"], r["o"]): (r["s"], r["m"], r["n"], r["l"]) for r in got.collect()}
        for g in "ab":
            seq = sorted([d for d in data if d[0] == g], key=lambda d: d[1], reverse=reverse)
            for i, d in enumerate(seq):
                prev = [x[2] for x in seq[:i] if x[2] is not None]
                upto = prev + ([d[2]] if d[2] is not None else [])
                want = (sum(upto) if upto else None, max(prev, default=None), min(prev, default=None), prev[-1] if prev else None)
                assert have[(g, d[1])] == want


def test_row_numbers_over_string_order(spark):
    rng = random.Random(8)
    data = [(rng.choice("ab"), "".join(rng.choices("xyz~!", k=6))) for _ in range(300)]
    df = sorted_buckets(spark.createDataFrame(data, "g string, p string"), ["g", "p"])
    got = rows(row_numbers(df, ["g"], ["p"], F.col("__range"), "n").select("g", "n", "p"))
    want = [(g, i + 1, p) for g in "ab" for i, p in enumerate(sorted(x for h, x in data if h == g))]
    assert got == sorted(want, key=repr)


# Worked by hand from rank = p / 100 * n - 1, at least 0, between neighbours.
PERCENTILES = {
    1: {"two": 1, "twenty": 0, "flat": 3, "tail": 1, "outliers": 1, None: 2},
    50: {"two": 1, "twenty": 9, "flat": 3, "tail": 1, "outliers": 3.5, None: 2},
    95: {"two": 8.2, "twenty": 18, "flat": 3, "tail": 1, "outliers": 1e14 + 0.65 * (1e18 - 1e14), None: 3.8},
    100: {"two": 9, "twenty": 19, "flat": 3, "tail": 1e12, "outliers": 1e18, None: 4},
}


@pytest.mark.parametrize("p", list(PERCENTILES))
def test_percentile_interpolation(spark, p, monkeypatch):
    monkeypatch.setattr(T, "BINS", 4)
    monkeypatch.setattr(T, "FINAL_ROWS", 3)
    groups = {"one": [5.0], "two": [9.0, 1.0], "twenty": [float(i) for i in range(20)], "flat": [3.0] * 50,
              "tail": [1.0] * 60 + [1e12], "outliers": [1.0, 2.0, 3.0, 4.0, 1e10, 1e14, 1e18], None: [2.0, 4.0], "nothing": [None]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r["g"]: r["percentile"] for r in T.percentile_interp(df, ["g"], "v", p).collect()}
    assert math.isnan(got.pop("one"))
    assert got == {g: pytest.approx(v) for g, v in PERCENTILES[p].items()}


def test_pivot_of_very_many_groups(spark):
    df = spark.range(12_000).select((F.col("id") % 2).alias("x"), F.concat(F.lit("g"), "id").alias("g"), F.lit(2.0).alias("y"))
    got = T.pivot_mean(df, "x", "g", "y")
    assert got.count() == 24_000 and got.where("y = 2").count() == 12_000 and got.where("y = 0").count() == 12_000
    assert rows(T.pivot_mean(df, "x", "g", "y", ["g1", "none"])) == [(0, "g1", 0.0), (0, "none", 0.0), (1, "g1", 2.0), (1, "none", 0.0)]


def stamp(second):
    return f"2024-05-01T10:{second // 60:02d}:{second % 60:02d}.000000+00:00"


def run_lines(seed):
    rng = random.Random(seed)
    out = ["", "garbage", json.dumps({"message": "Running", "time": stamp(0)})]
    second = 0
    for _ in range(3):
        out.append(json.dumps({"message": "Run started", "time": stamp(second), "workers": rng.randrange(1, 4)}))
        for _ in range(40):
            second += rng.randrange(0, 3)
            kind = rng.choice(["completed", "read", "read", "delay", "Unmerged rows"])
            line = {"message": kind, "time": stamp(second)}
            if kind == "completed":
                line.update(real_time=stamp(second), operation="inc", worker=rng.randrange(3), rt=rng.random())
            elif kind == "read":
                line.update(worker=rng.randrange(3), totalCounters=10)
                line.update({f"_c-{rng.randrange(4)}": rng.randrange(60) for _ in range(3)})
            elif kind == "delay":
                line.update(connId=rng.randrange(2), delay=rng.randrange(100))
            else:
                line.update(connId=rng.randrange(2), count=rng.randrange(100))
            out.append(json.dumps(line))
            if rng.random() < 0.1:
                out.append('{"broken": ')
    return out


LAG_LOG = [
    {"message": "Running", "time": stamp(0)},
    {"message": "Run started", "time": stamp(0), "workers": 2},
    {"message": "read", "time": stamp(1), "worker": 1, "totalCounters": 4, "_a": 10},
    {"message": "completed", "time": stamp(1), "real_time": stamp(1), "operation": "inc", "worker": 1, "rt": 0.1},
    {"message": "read", "time": stamp(2), "worker": 0, "totalCounters": 4, "_a": 7},            # 10 - 7 of 1 key: 3 * 4 / 1
    {"message": "read", "time": stamp(3), "worker": 2, "totalCounters": 4, "_a": 8, "_b": 5, "_bad": "zz", "_half": 1.5},
    {"message": "read", "time": stamp(4), "worker": 0, "totalCounters": 4, "_a": 12},           # none of a, 5 of b: 5 * 4 / 2
    {"message": "completed", "time": stamp(4), "real_time": stamp(4), "operation": "inc", "worker": 1, "rt": 0.1},
    {"message": "completed", "time": stamp(5), "real_time": stamp(5), "operation": "inc", "worker": 2, "rt": 0.1},
    {"message": "Run started", "time": stamp(6), "workers": 3},
    {"message": "read", "time": stamp(7), "worker": 0, "totalCounters": 4, "_a": 1},            # nothing known yet in this run
    {"message": "completed", "time": stamp(8), "real_time": stamp(8), "operation": "inc", "worker": 2, "rt": 0.1},
]


def test_lag_worked_by_hand(spark):
    log = S.parse_run_log(spark.createDataFrame([(i + 1, json.dumps(x)) for i, x in enumerate(LAG_LOG)], "line long, value string"))
    def lag(width):
        return sorted((r["time"], r["workers"], r["delay"], round(r["tps"], 6)) for r in T.lag_over_time(log, 0, width).collect())
    assert lag(2) == [(0.0, 2, 0.0, 0.5), (2.0, 2, 12.0, 0.0), (4.0, 2, 10.0, 1.0), (6.0, 3, 0.0, 0.0), (8.0, 3, 0.0, 0.5)]
    assert lag(7) == [(0.0, 2, 11.0, 0.428571), (7.0, 3, 0.0, 0.142857)]


def test_lag_equals_a_row_per_read_and_counter(spark, monkeypatch):
    monkeypatch.setattr(T, "LINES_PER_BUCKET", 8)
    rng = random.Random(9)
    main, others = [], []
    for line in range(300):
        named = {f"_c{rng.randrange(30)}": rng.randrange(-20, 60) for _ in range(rng.randrange(4))}
        (main if rng.random() < 0.4 else others).append((line // 100, line, named))
    want = {}
    for run, line, own in main:
        best = {}
        for r, at, named in others:
            if r == run and at < line:
                for k, v in named.items():
                    best[k] = max(best.get(k, 0), v)
        if best:
            want[line] = (sum(max(v - own.get(k, 0), 0) for k, v in best.items()), len(best))
    frames = [spark.createDataFrame(x, "run long, line long, counters map<string,long>") for x in (main, others)]
    got = {r["line"]: (r["__sum"], r["__keys"]) for r in T._behind(*frames).collect()}
    assert got == want


def test_run_log_lines_are_parsed_once(spark):
    text = ["", "[1]", "17", '"x"', "{", '{"message": "read", "worker": "no", "_a": 3, "_b": "4", "_c": null}', "{}", None]
    log = S.parse_run_log(spark.createDataFrame(list(enumerate(text)), "line long, value string"))
    got = {r["line"]: (r["message"], r["worker"], r["counters"]) for r in log.collect()}
    assert got == {5: ("read", None, {"_a": 3, "_b": 4}), 6: (None, None, {})}
    plan = log.where("message = 'read'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_run_log_analytics(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(T, "LINES_PER_BUCKET", 16)
    lines = run_lines(seed)
    path = tmp_path / "run.log"
    path.write_text("\n".join(lines) + "\n")
    log = S.read_run_log(spark, str(path))
    parsed = [(i + 1, json.loads(x)["message"]) for i, x in enumerate(lines) if x.startswith("{") and x.endswith("}")]
    assert [(r["line"], r["message"]) for r in log.orderBy("line").collect()] == parsed
    delays = [json.loads(x) for x in lines if '"delay"}' in x or '"delay": ' in x and '"message": "delay"' in x]
    total = T.delay_over_time(log, 10_000).agg(F.count("*")).collect()[0][0]
    assert total <= 2 * 3 and (total > 0) == bool(delays)
    assert T.delay_over_time(log, 1, site=1).where("site != 1").count() == 0
    unmerged = sorted(json.loads(x)["count"] for x in lines if "Unmerged rows" in x)
    assert sorted(r["count"] for r in T.backlog_over_time(log).collect()) == unmerged


def test_line_numbers_follow_file_order_across_splits(spark, tmp_path):
    for name, n in (("a.log", 900), ("b.log", 300)):
        (tmp_path / name).write_text("".join(f"{name} {i:05d}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = [r["value"] for r in S.numbered_lines(spark, str(tmp_path)).orderBy("line").collect()]
        numbers = rows(S.numbered_lines(spark, str(tmp_path)).select("line"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"a.log {i:05d}" for i in range(900)] + [f"b.log {i:05d}" for i in range(300)]
    assert sorted(n for (n,) in numbers) == list(range(1, 1201))


def test_results_by_name_with_file_stem(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,tps\nx,1.5\ny,\n")
    (tmp_path / "two.csv").write_text("tps,a,b\n2.5,z,q\n")
    paths = [str(tmp_path / f) for f in ("one.csv", "two.csv")]
    got = S.read_results(spark, paths, ("tps",))
    assert rows(got.select("_file", "a", "tps", "b")) == [("one", "x", 1.5, None), ("one", "y", None, None), ("two", "z", 2.5, "q")]
    assert S.read_results(spark, paths[:1], ("tps",), dropna=True).count() == 1


def test_traffic(spark):
    text = [
        "100.2 IP 10.0.0.1.5432 > 10.0.0.2.99: tcp 10", "100.9 IP 10.0.0.2.99 > 10.0.0.1.5432: tcp 7", "junk",
        "103.1 IP 10.0.0.3.9 > 10.0.0.1.5: tcp 1", "103.3 IP 10.0.0.1.9 > 10.0.0.2.5: udp 2",
    ]
    packets = S.parse_packets(spark.createDataFrame([(t,) for t in text], "value string"))
    traffic = T.traffic_per_second(packets, "10.0.0.1")
    assert rows(traffic) == [
        (0, "10.0.0.2", 10, 7, 1, 1), (1, "-", 0, 0, 0, 0), (2, "10.0.0.3", 0, 1, 0, 1), (3, "10.0.0.2", 2, 0, 1, 0)]
    totals = T.traffic_totals(traffic.withColumn("engine", F.lit("e")), 0, ["engine"])
    assert rows(totals.where("ip is null").drop("ip")) == [("e", 2, 1, 3)]
    assert totals.where("ip = '10.0.0.2'").collect()[0]["total"] == 2


def test_generators(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    made = generate_ops(ids, "l", 12, N)
    assert made.count() == 24
    keys = [r["key"] for r in made.where("id = 'a'").orderBy("pts.logical_time").collect()]
    assert keys == sorted(keys)
    assert generate_ops(ids, "c", 12, N).count() == 2
    with pytest.raises(ValueError):
        generate_ops(ids, "q", 1, N)
    chain = generate_nested_ops(spark.createDataFrame([(7,)], "root int"), 3, N)
    assert rows(chain.select("id", "data")) == [("m-7-1", "m-7-2"), ("m-7-2", "m-7-3"), ("m-7-3", "m-7-4")]
    p = present(spark, [op(id="a"), op(id="b")])
    assert sorted(r["id"] for r in clone_structure(p, "a", "a-", 3).collect()) == ["a-1", "a-2", "a-3"]
    assert clone_structure(p, "a", "a-", 0).count() == 0
