"""Literal operation tables for tests."""

from causalog.schema import OP, PRESENT

N = 3


def op(id="x", key="k", type="m", data=None, site=1, lts=(1, 0, 0), pts=(1, 1), op="a", seq=0, hops=0, arrival=0):
    return (id, key, type, data, site, list(lts), pts, op, seq, hops, arrival)


def ops(spark, rows):
    return spark.createDataFrame(rows, OP)


def present(spark, rows):
    return spark.createDataFrame([(*r[:8], 0) for r in rows], PRESENT)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def as_dict(df):
    return {r["id"]: r["data"] for r in df.collect()}


def below(a, b):
    return all(x <= y for x, y in zip(a, b))


def frontier(versions):
    """Brute force: versions (key, lts, payload) no other version of the key dominates."""
    return sorted(
        v for v in versions
        if not any(v[0] == w[0] and v[1] != w[1] and below(v[1], w[1]) for w in versions)
    )
