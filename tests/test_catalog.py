"""Every query against its DuckDB statement on the smallest tables."""

import os

import duckdb
import pytest

from tidewater.plans import catalog, relational
from tidewater.plans.relational import TABLES

#: Queries whose faults the smallest tables may not hold.
EMPTY = {"secret_scan"}
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equal_to_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF_DIR)
    want = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = want.fetchall()
    assert plain(got.collect(), got.columns) == plain(rows, names)
    assert rows or name in EMPTY


def test_functions_over_pairs_of_groups_can_be_counted(spark):
    assert catalog.QUERIES["udf_cogroup"](spark, SF_DIR).count() > 0


@pytest.mark.parametrize("name", sorted(relational.STATEMENTS))
def test_plans_equal_the_same_statement_in_spark(spark, name):
    got, want = catalog.QUERIES[name](spark, SF_DIR), relational.run(spark, SF_DIR, relational.STATEMENTS[name])
    assert sorted(got.dtypes) == sorted(want.dtypes)
    assert plain(got.collect(), got.columns) == plain(want.collect(), want.columns)
