"""Registered text queries against their SQL, on the smallest tables that fill every source."""

import glob
import os

import duckdb
import pytest

from seriesloom.llm import queries as llm

DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR) or not os.path.isdir("/opt/tokenizers"), reason="no test tables or vocabularies")


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


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = llm.queries()[name](spark, DIR)
    cur = con.execute(llm.oracle_sql()[name])
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain([c[0] for c in cur.description], cur.fetchall())


def test_every_query_has_sql_or_a_reason():
    without = {"p8_mix", "p8_shares", "p9_found", "p9_languages", "p9_segments"}  # tokenizer, trained models
    assert set(llm.queries()) - set(llm.oracle_sql()) == without
