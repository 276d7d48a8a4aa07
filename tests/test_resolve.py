import pytest

from causalog.operators import lookup as L, resolve as R
from tests.helpers import as_dict, op, present, rows


def two_sites(spark, type, **extra):
    """Site 1 adds, then site 2 adds, then site 3 removes, all concurrent."""
    return present(spark, [
        op(type=type, site=1, lts=(1, 0, 0), pts=(1, 1), data="one", **extra),
        op(type=type, site=2, lts=(0, 1, 0), pts=(2, 1), data="two", **extra),
        op(type=type, site=3, lts=(0, 0, 1), pts=(3, 1), op="r", **extra),
    ])


def test_map_rules_with_two_adds_and_a_remove(spark):
    p = two_sites(spark, "m")
    entry = lambda df: [(r["data"]["key"], r["data"]["value"]) for r in df.collect()]
    assert entry(R.map_aw_mvr(p)) == [("k", ["one", "two"])]
    assert entry(R.map_aw_lww(p)) == [("k", "two")]
    assert entry(R.map_rw_mvr(p)) == []
    assert entry(R.map_lww(p)) == []


def test_set_rules(spark):
    p = two_sites(spark, "s")
    assert as_dict(R.set_aw(p)) == {"x": "k"}
    assert as_dict(R.set_rw(p)) == {} == as_dict(R.set_lww(p))
    adds = p.where("op = 'a'")
    assert as_dict(R.set_aw(adds)) == as_dict(R.set_rw(adds)) == as_dict(R.set_lww(adds)) == {"x": "k"}


def test_register_values_by_site_keep_null(spark):
    p = present(spark, [op(type="r", site=2, data="z", pts=(5, 1)), op(type="r", site=1, data=None, pts=(1, 1))])
    assert as_dict(R.register_mvr(p)) == {"x": [None, "z"]}
    assert as_dict(R.register_lww(p)) == {"x": "z"}


def test_equal_time_lowest_site_wins(spark):
    p = present(spark, [op(type="r", site=3, data="c", pts=(7, 2)), op(type="r", site=2, data="b", pts=(7, 2))])
    assert as_dict(R.register_lww(p)) == {"x": "b"}


def test_logical_time_breaks_equal_physical_time(spark):
    p = present(spark, [op(type="r", site=1, data="a", pts=(7, 2)), op(type="r", site=2, data="b", pts=(7, 3))])
    assert as_dict(R.register_lww(p)) == {"x": "b"}


def test_missing_time_counts_as_newest_and_null_data_sorts_last(spark):
    p = present(spark, [op(type="r", site=2, data="late", pts=(9, 1)), op(type="r", site=5, data="none", pts=None)])
    assert as_dict(R.register_lww(p)) == {"x": "none"}
    p = present(spark, [op(type="r", data=None, lts=(1, 0, 0)), op(type="r", data="b", lts=(2, 0, 0))])
    assert as_dict(R.register_lww(p)) == {"x": "b"}


def test_null_operation_is_neither_add_nor_visible(spark):
    p = present(spark, [op(type="s", op=None), op(type="s", key="j"), op(type="s", key="j", site=2, op=None)])
    assert rows(R.set_aw(p)) == [("x", "j")] == rows(R.set_rw(p))


def test_counter_sums_past_64_bit_parts(spark):
    big = 2**62
    p = present(spark, [op(type="c", key=str(s), site=s, data=str(v)) for s, v in ((1, big), (2, big), (3, -big))])
    assert as_dict(R.counter(p)) == {"x": big}


def test_list_reading_order(spark):
    p = present(spark, [
        op(type="l", key="b1", data="2"), op(type="l", key="B1", data="1"), op(type="l", key="c1", op="r"),
        op(type="l", key="~1", data=None),
    ])
    assert [r["data"] for r in R.list_view(p).collect()] == ["1", "2", None]
    assert as_dict(R.list_tuple(p)) == {"x": ["1", "2", None]}
    ids = p.select("id").distinct()
    assert as_dict(L.list_first(ids, p)) == {"x": "1"}
    assert as_dict(L.list_last(ids, p)) == {"x": None}


def test_views_ignore_other_types(spark):
    p = present(spark, [op(id="m", type="m", data="v"), op(id="s", type="s"), op(id="c", type="c", data="3", key="1")])
    assert set(as_dict(R.map_lww(p))) == {"m"}
    assert set(as_dict(R.set_aw(p))) == {"s"}
    assert set(as_dict(R.counter(p))) == {"c"}
    with pytest.raises(ValueError):
        R.view("bag", p)


def test_lookups_of_missing_structures(spark):
    p = present(spark, [op(type="s", key="a"), op(type="c", id="n", key="1", data="4"), op(type="m", id="m", data="v")])
    ids = spark.createDataFrame([("x",), ("gone",)], "id string")
    assert as_dict(L.set_get(ids, p)) == {"x": ["a"], "gone": None}
    probes = spark.createDataFrame([("x", "a"), ("x", "b"), ("gone", "a")], "id string, elem string")
    assert rows(L.set_contains(probes, p)) == [("gone", "a", False), ("x", "a", True), ("x", "b", False)]
    keys = spark.createDataFrame([("m", "k"), ("m", "j")], "id string, key string")
    assert rows(L.map_value(keys, p)) == [("m", "j", None), ("m", "k", "v")]
    assert rows(L.map_contains(keys, p)) == [("m", "j", False), ("m", "k", True)]
    assert as_dict(L.counter_get(ids, p)) == {"x": None, "gone": None}
    assert L.counter_get_multiple(ids, p).count() == 0
    assert as_dict(L.counter_get_all(p)) == {"n": 4}
    with pytest.raises(ValueError):
        L.set_get(ids, p, "mvr")


def test_list_index_out_of_range(spark):
    p = present(spark, [op(type="l", key=k, data=k) for k in ("a", "b", "c")])
    probes = spark.createDataFrame([("x", 0), ("x", 2), ("x", 3)], "id string, index int")
    assert rows(L.list_get_at(probes, p)) == [("x", 0, "a"), ("x", 2, "c"), ("x", 3, None)]


def test_typed_table_rules(spark):
    schema = "cart_id bigint, product_id bigint, quantity int, op string, site int, lts array<bigint>, pts struct<physical_time bigint, logical_time int>"
    cart = spark.createDataFrame([
        (1, 5, 2, "a", 1, [1, 0], (1, 1)), (1, 5, 3, "r", 2, [0, 1], (2, 1)), (1, 6, 1, "a", 1, [2, 0], (3, 1)),
    ], schema)
    assert rows(R.cart_lww(cart)) == [(1, 6, 1)]
    assert rows(R.cart_products(cart, 1)) == [(6, 1)]
    assert rows(R.carts_with_product_range(cart, 5, 5)) == []
    assert R.resolve(cart, ["cart_id", "product_id"], "aw").count() == 2
    assert R.resolve(cart, ["cart_id", "product_id"], "rw").count() == 1
