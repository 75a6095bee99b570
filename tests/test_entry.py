"""The driver contract, and every query with SQL against that SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connection
from wattloom.plans import core_queries, data_queries

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and {"p3_found", "p4_found", "p5_found"} <= set(q)


@here
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@here
@pytest.mark.parametrize("name", [*core_queries.SQL, *data_queries.SQL])
def test_sql(spark, con, name):
    part = core_queries if name in core_queries.SQL else data_queries
    got, want, same = compare(part.QUERIES[name](spark, SF), part.SQL[name], con)
    assert same, (got[:3], want[:3])


@here
@pytest.mark.parametrize("name", [n for p in (core_queries, data_queries) for n in p.QUERIES if n not in p.SQL])
def test_runs(spark, name):
    part = core_queries if name in core_queries.QUERIES else data_queries
    assert part.QUERIES[name](spark, SF).count() > 0


@here
def test_scan_is_pruned_and_pushed_down(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = core_queries.scan_pruned(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(split,TRAIN)" in plan and "GreaterThanOrEqual(target_hour_utc" in plan and "In(region" in plan
    assert "prompt" not in plan and "public_state_hash" not in plan


@here
def test_naive_times_are_utc_in_any_session(spark):
    from pyspark.sql import functions as F

    from wattloom.sources.tables import table

    def total():
        return table(spark, SF, "public_energy_state").agg(F.sum(F.unix_micros("target_hour_utc"))).first()[0]

    want = total()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert total() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
