import os
import re

import pytest

import __spark_entry__ as entry_point


def test_every_oracle_has_a_query():
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(oracles) >= 0.85 * len(queries)


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert {r["model"] for r in rows} == {"naive_last_year", "historical_mean"} and len(rows) == 6


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from cutline.sources import driver_tables as d

    rows = d.observed(spark, sf_dir).where("year >= 2000").select("institute", "closing_rank")
    text = plan(rows)
    assert "PartitionFilters: [isnotnull(year" in text
    assert re.search(r"ReadSchema: struct<institute:string,closing_rank:bigint>", text)


def test_no_pair_products_in_profile_matching(spark, sf_dir):
    from cutline.operators import profiles
    from cutline.sources import driver_tables as d

    table = d.observed(spark, sf_dir, "brand").where("year = 2001")
    for small in (True, False):
        text = plan(profiles.match_candidates(d.profiles(spark, sf_dir), table, checked_small=small))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_every_checking_sql_binds():
    """Shared parts of the SQL have one meaning each, and all of it resolves against the test tables."""
    import glob

    import duckdb

    from cutline.plans import ORACLES
    from cutline.plans.registry import cte

    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name, sql in ORACLES.items():
        con.execute("EXPLAIN " + sql)
    with pytest.raises(ValueError):
        cte("observed", "SELECT 1")
