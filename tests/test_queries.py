"""Registered core queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from seriesloom import queries as core

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(float(v)) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)
    return sorted(columns), sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
    return c


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = core.queries()[name](spark, DIR)
    cur = con.execute(core.oracle_sql()[name])
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain([c[0] for c in cur.description], cur.fetchall())


def test_every_query_has_sql_or_a_reason():
    without = {"p1_grid", "p2_found", "p2_implausible"}  # numeric; tested against brute force
    assert set(core.queries()) - set(core.oracle_sql()) == without


def test_filters_reach_the_scan(spark, capsys):
    from seriesloom.api import Connection
    from seriesloom.queries.engine import END, START, source

    Connection(spark, source=source(spark, DIR)).prepare_query('sum(events{event_type="click"} > 5)', START, END).plan.df.explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(x for x in plan.splitlines() if x.startswith("PushedFilters"))
    assert all(x in pushed for x in ("EqualTo(event_type,click)", "GreaterThan(value,5.0)", "GreaterThanOrEqual(ts,", "LessThanOrEqual(ts,"))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan
