"""Every registered query against its DuckDB oracle on the driver tables,
and the declared double columns against the Spark schema."""

from __future__ import annotations

import os
import sys

import pytest

from conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from check_oracle import duck, normalise  # noqa: E402

from souk.functions.canonical import double_columns  # noqa: E402
from souk.registry import QUERIES, oracle_sql, spark_query  # noqa: E402

WITH_ORACLE = [name for name, q in QUERIES.items() if q.oracle is not None]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_matches_duckdb(spark, con, name):
    got = spark_query(name)(spark, SF_SMALL).toPandas()
    want = con.sql(oracle_sql(name)).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = normalise(got), normalise(want)
    assert a.astype(str).equals(b.astype(str))


@pytest.mark.parametrize("name", list(QUERIES))
def test_declared_doubles(spark, name):
    df = spark_query(name)(spark, SF_SMALL)
    assert set(double_columns(df)) == set(QUERIES[name].doubles)


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


SKEW_CHECKED = (
    "link_table", "order_features", "order_seller_distance", "seller_mart", "product_mart",
    "removal_gain_curve", "box_wait_time", "city_rollup",
)


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    from make_skewed import make_skewed

    d = tmp_path_factory.mktemp("skewed")
    make_skewed(SF_SMALL, str(d))
    return str(d)


@pytest.mark.parametrize("hot_rows", [None, 200])
@pytest.mark.parametrize("name", SKEW_CHECKED)
def test_matches_duckdb_on_skewed_keys(spark, skewed, name, hot_rows):
    from souk.plans.skew import DEFAULT_HOT_KEY_ROWS, HOT_KEY_ROWS

    # 200 rows: the hot seller and the hot order are split into pieces
    spark.conf.set(HOT_KEY_ROWS, str(hot_rows or DEFAULT_HOT_KEY_ROWS))
    try:
        got = spark_query(name)(spark, skewed).toPandas()
    finally:
        spark.conf.set(HOT_KEY_ROWS, str(DEFAULT_HOT_KEY_ROWS))
    want = duck(skewed).sql(oracle_sql(name)).df()
    assert len(got) == len(want)
    assert normalise(got).astype(str).equals(normalise(want).astype(str))
