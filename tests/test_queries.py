from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import _rows
from lettermill.plans.catalog import QUERIES
from lettermill.plans.oracles import oracles
from tests.conftest import plan_of

SQL = oracles()
PYTHON = {"mime_decode"}


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_point.queries()) and set(SQL) <= set(entry_point.oracle_sql())


def test_retention_reaches_the_scan(spark, sf_dir):
    """The day is worked out from the time, so a table that stores the day shows the push."""
    from lettermill.operators.select import retain_by_topic
    from lettermill.plans.catalog import ASOF
    from lettermill.session import work_dir

    path = work_dir(spark, "records")
    spark.createDataFrame([("raw.emails.rejections", "2024-01-10")], "topic string, day string").write.parquet(path)
    assert "GreaterThanOrEqual(day" in plan_of(retain_by_topic(spark.read.parquet(path), "day", ASOF))


def test_windows_decide_differently(spark, sf_dir, db):
    """The window queries and their whole-text twins read the same mail and do not agree."""
    for whole, window in (("classify_whole_text", "classify_gate_window"), ("enrich_whole_text", "enrich_rejections_window")):
        assert db.execute(SQL[whole]).fetchall() != db.execute(SQL[window]).fetchall()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = db.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("stream_")))
def test_plans(spark, sf_dir, name):
    """No Python and no pairwise join in the default path; phrase tests stay out of filters."""
    plan = plan_of(QUERIES[name](spark, sf_dir))
    if name not in PYTHON:
        assert "EvalPython" not in plan and "MapInPandas" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    filters = [line for line in plan.splitlines() if " Filter " in line or "DataFilters" in line]
    costly = ("candidacy", "RLIKE", "split(", "regexp_replace(", "from_json(")
    assert not any(part in line for line in filters for part in costly)


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0 and "label" in df.columns
