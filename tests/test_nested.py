import json

import pytest

from causalog.operators.nested import nested_chunks, nested_json, nested_rows, validate_path
from tests.helpers import op, present, rows

# Whole documents with the rows that hold them: (path, root, rows, value).
DOCUMENTS = [
    (["map_lww", "list"], "order-1", [
        op(id="order-1", key="lines", data="lines-1"), op(id="order-1", key="notes", data="notes-1", site=2, lts=(0, 1, 0)),
        op(id="lines-1", type="l", key="P1", data="pen"), op(id="lines-1", type="l", key="Q1", data="ink"),
        op(id="notes-1", type="l", key="P1", data="urgent"),
    ], {"lines": ["pen", "ink"], "notes": ["urgent"]}),
    (["register_lww", "map_aw_lww", "counter"], "page", [
        op(id="page", type="r", key="", data="stats"), op(id="stats", key="views", data="views-c"), op(id="stats", key="likes", data="likes-c"),
        op(id="views-c", type="c", key="1", data="40"), op(id="views-c", type="c", key="2", data="2", site=2, lts=(0, 1, 0)),
        op(id="likes-c", type="c", key="1", data="7"),
    ], {"likes": 7, "views": 42}),
    (["set_aw", "set_rw", "register_lww"], "teams", [
        op(id="teams", type="s", key="red"), op(id="red", type="s", key="ann"), op(id="ann", type="r", key="", data="captain"),
    ], [["captain"]]),
    (["list", "list", "map_lww"], "table", [
        op(id="table", type="l", key="A1", data="row-1"), op(id="table", type="l", key="B1", data="row-2"),
        op(id="row-1", type="l", key="A1", data="cell-1"), op(id="row-2", type="l", key="A1", data="cell-2"),
        op(id="cell-1", key="w", data="3"), op(id="cell-2", key="w", data="5"),
    ], [[{"w": "3"}], [{"w": "5"}]]),
    (["counter"], "hits", [op(id="hits", type="c", key="1", data="11")], 11),
]


@pytest.mark.parametrize("path,root,log,value", DOCUMENTS, ids=[d[1] for d in DOCUMENTS])
def test_documents(spark, path, root, log, value):
    p = present(spark, log)
    (only,) = nested_json(p, path, spark.createDataFrame([(root,)], "id string")).collect()
    assert json.loads(only["data"]) == value
    assert json.loads({r["id"]: r["data"] for r in nested_json(p, path).collect()}[root]) == value


def joined(chunks, chars):
    out = {}
    for r in sorted(chunks.collect(), key=lambda r: (r["id"], r["part"])):
        out.setdefault(r["id"], []).append(r["text"])
        assert r["part"] == len(out[r["id"]]) - 1
    assert all(len(t) == chars for texts in out.values() for t in texts[:-1]) and all(texts[-1] for texts in out.values())
    return {i: "".join(texts) for i, texts in out.items()}


@pytest.mark.parametrize("path,root,log,value", DOCUMENTS, ids=[d[1] for d in DOCUMENTS])
def test_chunks_make_up_the_documents(spark, path, root, log, value):
    got = joined(nested_chunks(present(spark, log), path, spark.createDataFrame([(root,)], "id string"), 5), 5)
    assert {i: json.loads(t) for i, t in got.items()} == {root: value}


def test_chunks_of_shared_ragged_and_quoted_structures(spark):
    p = present(spark, [
        op(id="a", key="bb", data="s1", site=1), op(id="a", key="bb", data="s2", site=2, lts=(0, 1, 0)), op(id="a", key='q"', data="s2"),
        op(id="a", key="C", data="gone"), op(id="b", key="k", data="s2"), op(id="c", key="k", data="gone"), op(id="d", key="k", data=None),
        *[op(id="s1", type="s", key=f"e{i}" * 9) for i in range(12)], op(id="s2", type="s", key="f\n"), op(id="s2", type="s", key="é"),
    ])
    path = ["map_aw_mvr", "set_aw"]
    assert joined(nested_chunks(p, path, chars=11), 11) == {r["id"]: r["data"] for r in nested_json(p, path).collect()}
    assert nested_chunks(p.limit(0), path).count() == 0


def test_key_order_quoting_and_nulls(spark):
    p = present(spark, [
        op(key="bb", data='say "hi"\n'), op(key="a", data=None), op(key="é", data="x"), op(key="C", data="y"),
    ])
    (row,) = nested_json(p, ["map_lww"]).collect()
    assert row["data"] == '{"C":"y","a":null,"bb":"say \\"hi\\"\\n","é":"x"}'


def test_dangling_links_disappear(spark):
    p = present(spark, [op(key="a", data="s1"), op(key="b", data="gone"), op(id="s1", type="s", key="e")])
    assert [r["data"] for r in nested_json(p, ["map_lww", "set_aw"]).collect()] == ['{"a":["e"]}']
    assert rows(nested_rows(p, ["map_lww", "set_aw"])) == [("x", "a", "s1", "e")]


def test_multi_value_links(spark):
    p = present(spark, [
        op(key="a", data="s1", site=1), op(key="a", data="s2", site=2, lts=(0, 1, 0)),
        op(id="s1", type="s", key="e"), op(id="s2", type="s", key="f"),
        op(id="r", type="r", key="", data="s2", site=1), op(id="r", type="r", key="", data="s1", site=2, lts=(0, 1, 0)),
    ])
    assert [r["data"] for r in nested_json(p, ["map_aw_mvr", "set_aw"]).collect()] == ['{"a":[["e"],["f"]]}']
    assert [r["data"] for r in nested_json(p, ["register_mvr", "set_aw"]).collect()] == ['[["f"],["e"]]']
    assert [r["data"] for r in nested_json(p, ["register_mvr"]).collect()] == ['["s2","s1"]']


def test_shared_inner_structure_renders_in_every_parent(spark):
    p = present(spark, [op(id="a", key="k", data="c"), op(id="b", key="k", data="c"), op(id="c", type="c", key="1", data="7")])
    assert {r["id"]: r["data"] for r in nested_json(p, ["map_lww", "counter"]).collect()} == {"a": '{"k":7}', "b": '{"k":7}'}


def test_paths(spark):
    assert validate_path(["MapAwLww", "SetRw", "Counter"]) == ["map_aw_lww", "set_rw", "counter"]
    for bad in ([], ["bag"], ["counter", "set_aw"], ["set_aw_tuple"]):
        with pytest.raises(ValueError):
            validate_path(bad)


def test_chunks_write_leaves_once_and_pieces_without_sort_columns(spark, monkeypatch):
    from causalog.operators import nested as module

    written, stable = [], module.stable
    monkeypatch.setattr(module, "stable", lambda df: written.append(df.columns) or stable(df))
    path, _, log, value = DOCUMENTS[0]
    (only,) = nested_chunks(present(spark, log), path).collect()
    assert json.loads(only["text"]) == value
    leaves, pieces = written
    assert "__end" in leaves and pieces == ["id", "__row", "__range", "__piece"]
