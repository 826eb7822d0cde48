"""Each query with SQL against DuckDB on the smallest tables: columns, and rows as a multiset."""

import glob
import math
import os

import duckdb
import pytest

from quillgraph.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, list | tuple):
        return [plain(v) for v in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([plain(v[i]) for i in order]) for v in values))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_is_its_sql(spark, duck, name):
    out = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(out.columns) == sorted(names)
    got = rows(out.columns, [[v.asDict(True) if hasattr(v, "asDict") else v for v in r] for r in out.collect()])
    assert got == rows(names, want.fetchall())
