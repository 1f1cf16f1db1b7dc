"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest


from formulary.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "documents", "pages", "benchmark")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    want = duck.sql(plans.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    key = lambda r: tuple(map(str, r))
    want = [tuple(r[k] for k in at) for r in want.fetchall()]
    assert got, "an empty result proves nothing"
    assert sorted(got, key=key) == sorted(want, key=key)
