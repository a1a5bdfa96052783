"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from galena.model import TABLES
from galena.operators import resolve
from galena.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(v):
        if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
            v = float(v)
        return "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    want = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_rows_only(spark):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        catalogue.queries()[name](spark, SF).collect()


def test_class_orders_of_all_parts(spark):
    keys = {r["p_partkey"] for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    parents = {str(k): [str(p) for p in dict.fromkeys((k // 2, k // 3)) if p in keys] for k in keys}
    got = {r["id"]: r["order"] for r in catalogue.queries()["GR20_class_orders"](spark, SF).collect()}
    want = {k: resolve.c3(k, parents) for k in parents}
    assert got == {k: o and ">".join(o) for k, o in want.items()}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["total", "direct", "processes", "risk"]
    assert set(e.oracle_sql()) <= set(e.queries())
