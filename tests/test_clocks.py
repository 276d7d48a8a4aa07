from pyspark.sql import functions as F

from causalog.functions import clocks as C


def one(spark, **columns):
    df = spark.range(1).select(*[c.alias(n) for n, c in columns.items()])
    return df.collect()[0].asDict()


def clock(*xs):
    return F.array(*[F.lit(x).cast("long") for x in xs])


def test_order_of_clocks(spark):
    a, b, c = clock(1, 2, 3), clock(1, 3, 3), clock(2, 0, 0)
    for n in (None, 3):
        got = one(
            spark, le=C.vc_lte(a, b, n), eq=C.vc_lte(a, a, n), ge=C.vc_lte(b, a, n), lt=C.vc_lt(a, b, n),
            same=C.vc_lt(a, a, n), conc=C.vc_concurrent(a, c, n), not_conc=C.vc_concurrent(a, b, n),
        )
        assert got == dict(le=True, eq=True, ge=False, lt=True, same=False, conc=True, not_conc=False)


def test_short_clocks_are_padded_with_zeros(spark):
    got = one(
        spark, short=C.vc_lte(clock(1), clock(1, 0)), back=C.vc_lte(clock(1, 0), clock(1)),
        unrolled=C.vc_lte(clock(1, 1), clock(1), 2), top=C.vc_max(clock(5), clock(1, 2)), pad=C.vc_pad(clock(5), 3),
    )
    assert got == dict(short=True, back=True, unrolled=False, top=[5, 2], pad=[5, 0, 0])


def test_null_clock_gives_null(spark):
    none = F.lit(None).cast("array<bigint>")
    got = one(spark, a=C.vc_lte(none, clock(1)), b=C.vc_lte(clock(1), none, 1), z=C.vc_zero(2), i=C.vc_inc(clock(4, 4), 2))
    assert got == dict(a=None, b=None, z=[0, 0], i=[4, 5])


def test_hybrid_clock_step(spark):
    now = C.hlc(F.lit(10), F.lit(4))
    got = one(spark, ahead=C.hlc_next(now, F.lit(11)), behind=C.hlc_next(now, F.lit(3)), equal=C.hlc_next(now, F.lit(10)))
    assert tuple(got["ahead"]) == (11, 1)
    assert tuple(got["behind"]) == tuple(got["equal"]) == (10, 5)


def test_hybrid_clock_order_is_physical_then_logical(spark):
    assert one(spark, lt=C.hlc_order(C.hlc(F.lit(9), F.lit(99))) < C.hlc_order(C.hlc(F.lit(10), F.lit(1))))["lt"]


def test_current_time_of_group(spark):
    df = spark.createDataFrame([("a", [1, 5]), ("a", [3]), ("b", [0, 1])], "id string, lts array<bigint>")
    got = {r["id"]: r["lts"] for r in C.vc_max_agg(df, ["id"], 2).collect()}
    assert got == {"a": [3, 5], "b": [0, 1]}
