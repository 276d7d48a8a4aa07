"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from causalog.operators import lookup as L, merge as M, nested as N_, present as P, resolve as R
from causalog.plans.scan import Running, prefix_scan
from causalog.schema import OP, PRESENT
from tests.helpers import N, op, ops


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A log and a present on disk, read back so filters can reach the scan."""
    root = str(tmp_path_factory.mktemp("plans"))
    ops(spark, [op(key=str(i), lts=(i + 1, 0, 0)) for i in range(20)]).write.parquet(f"{root}/log")
    log = spark.read.schema(OP).parquet(f"{root}/log")
    M.as_merged(log).write.parquet(f"{root}/present")
    return log, spark.read.schema(PRESENT).parquet(f"{root}/present")


FORBIDDEN = ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas", "ArrowEvalPython")


def test_no_python_and_no_pair_joins(spark, stored):
    log, present = stored
    ids = present.select("id").distinct()
    frames = {name: R.view(name, present) for name in R.VIEWS}
    frames["causal"] = P.causal_present(log, N, mode="causal")
    frames["tops"] = P.coordinate_max_candidates(log, N)
    frames["merge"] = M.merge_ops(present, log, N, "causal")
    frames["obsolete"] = M.drop_obsolete(log, present, N)
    frames["superseded"] = M.superseded(present, log, N, "causal")
    frames["get"] = L.map_get(ids, present)
    frames["nested"] = N_.nested_json(present, ["map_lww", "set_aw"])
    for name, df in frames.items():
        text = plan(df)
        assert not [word for word in FORBIDDEN if word in text], name


@pytest.mark.parametrize("view", ["map_lww", "map_aw_lww", "set_rw", "register_lww", "counter", "list_tuple"])
def test_id_filter_reaches_the_scan(spark, stored, view):
    log, _ = stored
    text = plan(R.view(view, P.causal_present(log, N, mode="causal")).where("id = 'x'"))
    scan = text[text.index("FileScan"):]
    assert "EqualTo(id,x)" in scan and "EqualTo(type," in plan(R.view(view, log)) 


def test_aggregates_combine_before_the_shuffle(spark, stored):
    log, present = stored
    for df in (P.causal_present(log, N, mode="causal"), R.map_lww(present), R.counter(present)):
        text = plan(df)
        assert text.count("Exchange hashpartitioning") == 1
        assert "partial_" in text[text.index("Exchange"):]


def test_scan_reads_only_needed_columns(spark, stored):
    text = plan(R.counter(stored[1]))
    schema = text[text.index("ReadSchema"):].splitlines()[0]
    assert "lts" not in schema and "pts" not in schema and "data" in schema


def test_prefix_scan_shuffles_the_rows_once(spark, stored):
    log, _ = stored
    got = prefix_scan(log.select("id", "seq"), ["id"], ["seq"], F.floor(F.col("seq") / 8), {"n": Running("sum", F.lit(1))})
    wide = [x for x in plan(got).splitlines() if "Exchange hashpartitioning(id" in x and "__bucket" in x]
    assert len(wide) == 2  # the rows, and one total per bucket


@pytest.mark.parametrize("mode", ["regular", "appends", "prepends"])
def test_positions_are_expanded_once_and_not_broadcast(spark, tmp_path, mode):
    from workload.writes import SPARK

    customers = [(1, "BUILDING"), (7, None), (7, "MACHINERY"), (299, "AUTOMOBILE")]
    spark.createDataFrame(customers, "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    df = SPARK[f"bulk_positions_{mode}"](spark, str(tmp_path))
    assert plan(df).count("Generate explode(sequence(0") == 1
    # Customer 7 stands twice: each of 16 positions meets both lists, and both next positions but for the last rank.
    got = {r["id"]: (r["n"], r["ordered"], r["short"]) for r in df.collect()}
    assert got == {"1": (2, True, True), "7": (2 * 2 * (2 * 7 + 1), False, True), "299": (300, True, True)}
