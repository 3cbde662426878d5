"""Every registered query against its SQL, over the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from veinstone.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    match v:
        case None | bool() | int() | str() | bytes() | datetime.datetime():
            return repr(v)
        case float() | decimal.Decimal():
            return f"{float(v):.8g}"
        case dict():
            return plain(list(v.values()))
        case list() | tuple():
            return "[" + ",".join(map(plain, v)) + "]"
    return plain(v.asDict()) if hasattr(v, "asDict") else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
