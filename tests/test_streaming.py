import random

from pyspark.sql import functions as F

from causalog.operators.merge import as_merged, merge_ops
from causalog.operators.present import causal_present
from causalog.sources.ops import append_ops, read_ops, read_ops_stream
from causalog.streaming.frontier import COLUMNS, present_stateful
from causalog.streaming.store import PresentTable, merge_stream, reject_stream, write_present
from tests.helpers import N, op, ops, present, rows
from tests.test_present import causal_log


def write_files(spark, path, log, files):
    for i in range(files):
        append_ops(ops(spark, log[i::files]).coalesce(1), path)


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    log = causal_log(21, 240)
    random.Random(1).shuffle(log)
    src, out, ck = (str(tmp_path / n) for n in ("log", "present", "ck"))
    write_files(spark, src, log[:120], 3)
    store = PresentTable(spark, out, N)

    def run():
        merge_stream(read_ops_stream(spark, src, N, max_files=1)[0], store, ck, available_now=True).awaitTermination()

    run()
    half = rows(store.read())
    assert half == rows(merge_ops(present(spark, []), ops(spark, log[:120]), N))
    done = store.rows().count()
    run()
    assert store.rows().count() == done
    write_files(spark, src, log[120:], 2)
    run()
    assert rows(store.read()) == rows(merge_ops(present(spark, []), ops(spark, log), N))


def test_batches_in_any_order_and_again(spark, tmp_path):
    log = causal_log(8, 120)
    want = rows(merge_ops(present(spark, []), ops(spark, log), N))
    parts = [log[i::4] for i in range(4)]
    for n, order in enumerate(([0, 1, 2, 3], [3, 1, 0, 2, 2, 1])):
        store = PresentTable(spark, str(tmp_path / f"p{n}"), N)
        for i in order:
            store.merge(ops(spark, parts[i]))
        assert rows(store.read()) == want
        assert rows(store.compacted(str(tmp_path / f"c{n}")).rows()) == want


def test_two_streams_into_one_store(spark, tmp_path):
    log = causal_log(5, 160)
    store = PresentTable(spark, str(tmp_path / "p"), N)
    for name, part in (("a", log[:100]), ("b", log[60:])):
        src = str(tmp_path / name)
        write_files(spark, src, part, 2)
        merge_stream(read_ops_stream(spark, src, N, max_files=1)[0], store, f"{src}-ck", available_now=True).awaitTermination()
    want = rows(merge_ops(present(spark, []), ops(spark, log), N))
    assert rows(store.read()) == want
    table = store.compacted(str(tmp_path / "c"))
    table.append(store.rows())
    assert rows(table.read()) == want


def test_a_batch_written_in_part_is_completed_by_its_replay(spark, tmp_path):
    log = causal_log(3, 60)
    store = PresentTable(spark, str(tmp_path / "p"), N)
    store.append(as_merged(ops(spark, log)).limit(20))
    store.merge(ops(spark, log))
    assert rows(store.read()) == rows(merge_ops(present(spark, []), ops(spark, log), N))


def test_a_new_table_is_empty_and_an_old_one_is_taken_up(spark, tmp_path):
    path = str(tmp_path / "p")
    assert PresentTable(spark, path, N).read().count() == 0
    PresentTable(spark, path, N).merge(ops(spark, [op(data="a")]))
    PresentTable(spark, path, N).merge(ops(spark, []))
    assert [r["data"] for r in PresentTable(spark, path, N).read().collect()] == ["a"]


def test_rejects_of_a_stream_are_kept(spark, tmp_path):
    src, out = str(tmp_path / "log"), str(tmp_path / "rejects")
    append_ops(ops(spark, [op(), op(type="?"), op(site=8)]), src)
    good, bad = read_ops_stream(spark, src, N)
    reject_stream(bad, out, str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    store = PresentTable(spark, str(tmp_path / "p"), N)
    merge_stream(good, store, str(tmp_path / "ck2"), available_now=True).awaitTermination()
    assert store.read().count() == 1


def test_write_present_keeps_merge_times(spark, tmp_path):
    rows_in = present(spark, [op(), op(key="j", site=2, lts=(0, 1, 0))])
    assert rows(write_present(rows_in, str(tmp_path / "p"), N).read()) == rows(rows_in)


def test_stateful_changes_sum_to_the_frontier(spark, tmp_path):
    log = causal_log(31, 200)
    random.Random(2).shuffle(log)
    for causal in (False, True):
        src, out, ck = (str(tmp_path / f"{n}{causal}") for n in ("log", "changes", "ck"))
        write_files(spark, src, log + log[:30], 3)
        changes = present_stateful(read_ops_stream(spark, src, N, max_files=1)[0], causal)
        changes.writeStream.outputMode("update").foreachBatch(
            lambda batch, n: batch.withColumn("n", F.lit(n)).write.mode("append").parquet(out)
        ).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        net = spark.read.parquet(out).groupBy("id", "key", *COLUMNS).agg(
            F.sum(F.when(F.col("change") == "in", 1).otherwise(-1)).alias("net")).where("net != 0")
        assert net.where("net != 1").count() == 0
        want = causal_present(ops(spark, log), N)
        assert rows(net.select("id", "key", "site", "lts", "data", "op")) == rows(want.select("id", "key", "site", "lts", "data", "op"))


def test_stateful_stream_starts_from_a_present_and_takes_short_clocks(spark, tmp_path):
    start = present(spark, [op(key="a", data="old", lts=(1, 0, 0)), op(key="b", data="keep", lts=(1, 0, 0))])
    log = [op(key="a", data="new", site=2, lts=(1, 1)), op(key="c", data="far", site=3, lts=(2,)), op(key="a", data="old", lts=(1, 0, 0))]
    for causal in (False, True):
        src, out, ck = (str(tmp_path / f"{n}{causal}") for n in ("log", "changes", "ck"))
        write_files(spark, src, log, 1)
        changes = present_stateful(read_ops_stream(spark, src, N)[0], causal, start)
        changes.writeStream.outputMode("update").foreachBatch(
            lambda batch, n: batch.write.mode("append").parquet(out)
        ).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        got = sorted((r["key"], r["change"], r["data"]) for r in spark.read.parquet(out).collect())
        assert got == [("a", "in", "new"), ("a", "out", "old"), ("c", "in", "far")]


def test_log_round_trip_and_rejects(spark, tmp_path):
    path = str(tmp_path / "log")
    append_ops(ops(spark, [op(), op(type="?"), op(site=8)]), path)
    good, bad = read_ops(spark, path, N)
    assert good.count() == 1 and bad.count() == 2


def test_the_processor_takes_rows_and_keeps_every_present_row():
    from pyspark.sql import Row
    from causalog.streaming.frontier import FrontierProcessor

    class State(list):
        get = list.__iter__
        appendValue = list.append

        def put(self, values):
            self[:] = values

    def row(data, site, lts):
        return Row(id="x", key="k", **dict(zip(COLUMNS, ("m", data, site, lts, 1, 1, "a", None))))

    processor, processor._rows = FrontierProcessor(), State()
    for start in (row("one", 1, [1, 0, 0]), row("two", 2, [0, 1, 0])):
        processor.handleInitialState(("x", "k"), start, None)
    out = processor.handleInputRows(("x", "k"), iter([row("new", 1, [2, 0, 0]), row("late", 3, [0, 0, 0])]), None)
    assert [(r.change, r.data) for r in out] == [("out", "one"), ("in", "new")]
    assert [r[1] for r in processor._rows] == ["two", "new"]
