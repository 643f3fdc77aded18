import glob
import os

import duckdb
import pytest

from tilefold import queries, queries_factors, queries_scans, queries_solvers, queries_sources, queries_tiles  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM read_parquet('{t}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, sf, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    found = duck.execute(queries.ORACLES[name])
    names = [x[0] for x in found.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())
    assert got == want and sorted(names) == cols


def test_independent_set(spark, sf):
    """No two nodes within two steps, and every other node within two steps of one."""
    near = {}
    for e in queries.graph_of_parts(spark, sf).collect():
        near.setdefault(e["src"], set()).add(e["dst"])
        near.setdefault(e["dst"], set()).add(e["src"])
    taken = {r["node"] for r in queries.QUERIES["graph_independent_set"](spark, sf).collect()}
    within = {n: {n} | near[n] | {k for m in near[n] for k in near[m]} for n in near}
    assert all(len(within[n] & taken) >= 1 for n in near) and all(within[n] & taken == {n} for n in taken)


def test_entry():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
