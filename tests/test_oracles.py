"""Every query with an SQL statement gives the same rows as that statement on the same files."""

import decimal
import math
import re

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LIBRARY = entry._registry()
QUERIES, ORACLES = LIBRARY.QUERIES, LIBRARY.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check_plan(plan):
    """No cross join, no row-at-a-time Python, no window that puts a whole table into one task.

    Windows over ``_b`` run over bucket totals, a few hundred rows at any scale.
    """
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan
    for spec in re.findall(r"windowspecdefinition\(([^)]*)", plan):
        assert spec.startswith("_b#") or not re.match(r"\s*\w+#\d+L? (ASC|DESC)", spec), spec


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    check_plan(df._jdf.queryExecution().executedPlan().toString())
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, df.collect()) == table(columns, cursor.fetchall())


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
