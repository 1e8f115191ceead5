"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from palimspark import queries

SF = "/root/testdata/sf0.001"


def cell(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return "None" if x is None else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = want.fetchall()
    assert sorted(tuple(cell(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_solvers_on_order_histories(spark):
    value = {n: {r.page_id: r for r in queries.QUERIES[n](spark, SF).collect()} for n in ("knapsack_exact", "knapsack_greedy", "knapsack_fptas", "knapsack_sparse")}
    for page, best in value["knapsack_exact"].items():
        assert best.weight <= 4000
        for name, rows in value.items():
            assert rows[page].weight <= 4000 and rows[page].value <= best.value
        assert value["knapsack_sparse"][page].value == best.value
        assert value["knapsack_fptas"][page].value >= 0.9 * best.value
