"""Every registered query against its SQL twin, and the shape of every plan."""

import math

import pytest

from fleetlens.plans import ORACLES, QUERIES
from fleetlens.plans import stream_queries

STREAMING = {n for n in QUERIES if n.startswith("stream_")}
ORDERED = {"list_tests_page"}


def cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        if math.isnan(value):
            return None
        return round(float(value), 5) + 0.0
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert name in ORACLES
    found = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert canonical(df.columns, rows) == canonical(found.columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMING))
def test_plan_shape(spark, sf, name):
    """No nested-loop or cartesian joins, and no Python in the plan."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert bad not in plan, bad


@pytest.mark.parametrize("name", ["history_last_n", "last_m_points", "context_window"])
def test_row_limits_apply_before_the_shuffle(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


def test_rate_needs_one_shuffle(spark):
    from fleetlens.operators.ranges import rate

    samples = spark.range(1000).selectExpr("'m' AS metric", "id AS ts", "double(id) AS value")
    plan = rate(samples, ["metric"], 300, 0, 1000, 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["search_instances"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan
    plan = QUERIES["latest_engine_config"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan
    plan = QUERIES["vector_ratio"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "In(event_type, [error,view])" in plan and "props" not in plan


def test_entry(spark):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0


def test_event_stream_is_streaming(spark, sf):
    assert stream_queries.event_stream(spark, sf).isStreaming


def test_resampling_reads_its_input_once(spark, sf):
    df = QUERIES["resample_1h"](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan


def test_half_of_a_total_beyond_2_53(spark, tmp_path):
    import duckdb

    # 200 parts of 50 TiB, and an odd number of bytes.
    parts = spark.range(1600).selectExpr("id AS p_partkey", "'b' AS p_brand", "IF(id = 6, 49, 50) AS p_size")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.sql(ORACLES["inventory_totals"]).fetchall()
    assert want[0][1] > 2**53 and want[0][1] % 2 == 1
    assert [tuple(r) for r in QUERIES["inventory_totals"](spark, str(tmp_path)).collect()] == want


def test_deployment_pairs_are_shuffled_once_and_not_merged(spark, tmp_path):
    """Pairs keep the session's partitions, a join of them reads one shuffle, and pairs without a key match nothing."""
    import duckdb

    from fleetlens.sources import fixtures as fx

    keys = ["IF(id % 7 = 0, NULL, id % 50) AS l_partkey", "IF(id % 11 = 0, NULL, id % 9) AS l_suppkey"]
    spark.range(2000).selectExpr(*keys).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert fx.deploy_requests(spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    found = con.sql(ORACLES["apply_recommendation"])
    df = QUERIES["apply_recommendation"](spark, str(tmp_path))
    assert canonical(df.columns, df.collect()) == canonical(found.columns, found.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
