"""Every registered query with an oracle against DuckDB, over the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from moodspark.plans.catalogue import ORACLES, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 8) + 0.0
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)[:19]
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    expected = [tuple(plain(row[columns.index(c)]) for c in names) for row in result.fetchall()]
    assert ordered(rows) == ordered(expected)


def plan(df):
    return df._jdf.queryExecution().toString()


PYTHON = ("clean_text", "classify_emotion", "positional_zip", "cache_latest")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(PYTHON)))
def test_built_in_operators_run_no_python(name, spark):
    text = plan(QUERIES[name](spark, DIR))
    assert "ArrowEvalPython" not in text and "MapInArrow" not in text and "BatchEvalPython" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["filter_cohort"](spark, DIR))
    assert "EqualTo(lang,fr)" in text
    assert "text" not in text.split("ReadSchema")[1].split("\n")[0]
