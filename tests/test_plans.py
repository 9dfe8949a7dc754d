"""Plan checks: no Python in the hot path, scans read only needed columns,
ranking never funnels the rows through one partition, an unused lookup is
dropped, and no nested-loop join appears once nothing can be broadcast."""

from __future__ import annotations

import pytest

from conftest import SF_SMALL
from souk.operators import sellers, segments
from souk.registry import QUERIES, marketplace, spark_query

PYTHON_NODES = ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
                "FlatMapGroupsInPandas", "MapInArrow")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# scans of CSV files with quoted line breaks, QR factors and drawn weights run Python on Arrow batches
ON_BATCHES = ("csv_reviews", "csv_rejects", "significant_coefs_qr", "mean_wait_time_ci")


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ON_BATCHES])
def test_no_python_in_plans(spark, name):
    text = plan(spark_query(name)(spark, SF_SMALL))
    assert not any(node in text for node in PYTHON_NODES), name


def test_scan_reads_only_needed_columns(spark):
    text = plan(sellers.seller_aggregates(marketplace(spark, SF_SMALL)))
    li = [line for line in text.splitlines() if "lineitem" in line and "ReadSchema" in line]
    assert li
    for line in li:
        schema = line.split("ReadSchema:")[1]
        for unused in ("l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_discount"):
            assert unused not in schema


def test_ranking_funnels_only_aggregates_into_one_partition(spark):
    m = marketplace(spark, SF_SMALL)
    ranked = segments.ranked_sellers(sellers.seller_mart(m))
    lines = plan(ranked).splitlines()
    singles = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert singles
    # only partial aggregates (one row per partition: counts, sums) are
    # gathered in one partition, never the seller rows themselves
    for i in singles:
        assert "HashAggregate" in lines[i + 1], lines[i + 1]


def test_unused_order_date_lookup_is_dropped(spark):
    m = marketplace(spark, SF_SMALL)
    text = m.order_items.select("order_id", "seller_id", "price")._jdf.queryExecution(
    ).optimizedPlan().toString()
    assert "Join" not in text and "xxhash" not in text


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_nested_loop_join_without_broadcasts(spark, name):
    # as at scale, where no table is small enough to broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark_query(name)(spark, SF_SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def scans(spark, name: str) -> int:
    """File scans in the plan as first made (exchanges reused)."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return plan(spark_query(name)(spark, SF_SMALL)).count("FileScan parquet")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


@pytest.mark.parametrize("name, most", [("link_table", 3), ("order_features", 3), ("order_features_distance", 12)])
def test_tables_are_scanned_few_times(spark, name, most):
    assert scans(spark, name) <= most
