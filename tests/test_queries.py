"""Every query with SQL equals DuckDB on the smallest tables; the others give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.catalog.QUERIES]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    got = rows(entry.queries()[name](spark, SF).toPandas())
    sql = entry.oracle_sql().get(name)
    if sql:
        assert got == rows(duck.execute(sql).df())
    assert got[1]


def test_entry(spark):
    assert entry.entry(spark).columns == ["conv_id", "reply"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_report_of_every_part(spark):
    got = entry.queries()["health_report_all"](spark, SF).collect()
    checks = [line for r in got for line in r.report.split("\n") if not line.strip().startswith("fix: ")]
    assert len(checks) == entry.catalog.table(spark, SF, "part").count() > 60
