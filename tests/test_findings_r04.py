"""Queries that are to do the whole of their job."""

import duckdb

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


def test_day_bootstrap_draws_every_replicate(spark):
    """As many as the reference draws, from the query and from its SQL, with equal gaps."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    want = sorted(con.sql(__spark_entry__.oracle_sql()["day_bootstrap"]).fetchall())
    got = sorted(map(tuple, __spark_entry__.queries()["day_bootstrap"](spark, SMALL).collect()))
    # no replicate of this table lacks a side
    assert [r[0] for r in got] == list(range(10_000)) and got == want
