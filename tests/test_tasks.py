"""Work by order is dealt out over partitions that follow the tables' rows, with the
results that the session's own partitions give."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest
from conftest import market, money, ts
from pyspark.sql import functions as F

from souk.operators import products, sellers
from souk.operators.economics import DEFAULT_RATES
from souk.operators.incremental import PRODUCTS, SELLERS, MartStore
from souk.operators.reviews import order_review_stats
from souk.plans.skew import HOT_KEY_ROWS, ROWS_PER_TASK, sketch, spread_sums, tasks_for
from souk.sources.export import shared_path
from souk.sources.star import star_order_items

SETTINGS = (HOT_KEY_ROWS, ROWS_PER_TASK, "spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def small_tasks(spark):
    before = {c: spark.conf.get(c, None) for c in SETTINGS}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda hot=190: (spark.conf.set(ROWS_PER_TASK, "40"), spark.conf.set(HOT_KEY_ROWS, str(hot)))
    for c, v in before.items():
        spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def shop(spark):
    """300 orders, one of them with very many items and reviews, some without either;
    items and reviews of no order."""
    orders = [
        {"order_id": f"o{i}", "customer_id": "c", "order_status": "delivered" if i % 5 else "shipped",
         "order_purchase_timestamp": ts("2018-01-01"), "order_approved_at": ts(f"2018-01-{1 + i % 28:02}"),
         "order_delivered_carrier_date": ts("2018-01-09"),
         "order_delivered_customer_date": ts(f"2018-02-{1 + i % 28:02}") if i % 7 else None}
        for i in range(300)
    ]
    of = [f"o{i}" for i in range(320) if i % 9] + ["o1"] * 100 + [None] * 30
    items = [
        {"order_id": o, "order_item_id": i, "product_id": f"p{i % 11}" if i % 13 else None, "seller_id": f"s{i % 6}",
         "price": money(f"{i}.5"), "freight_value": money(i % 4), "shipping_limit_date": ts("2018-01-05")}
        for i, o in enumerate(of)
    ]
    rated = [f"o{i}" for i in range(310) if i % 4] + ["o1"] * 120 + [None] * 5
    reviews = [
        {"review_id": f"r{i}", "order_id": o, "review_score": i % 6 or None} for i, o in enumerate(rated)
    ]
    return market(
        spark, orders=orders, order_items=items, order_reviews=reviews,
        sellers=[{"seller_id": f"s{i}", "seller_city": "x", "seller_state": "y"} for i in range(6)],
        products=[{"product_id": f"p{i}", "product_category_name": "a"} for i in range(11)],
        category_translation=[{"product_category_name": "a", "product_category_name_english": "b"}],
    )


def _rows(df):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


def _partitions(df, keys):
    """The partitions of each shuffle by ``keys``."""
    text = df._jdf.queryExecution().executedPlan().toString()
    by = ", ".join(rf"{k}#\d+L?" for k in keys.split())
    return {int(n) for n in re.findall(rf"Exchange hashpartitioning\({by}, (\d+)\)", text)}


PAIRS = [sellers.pair_sums, products.pair_sums]


@pytest.mark.parametrize("pairs", PAIRS)
def test_shuffles_by_order_follow_the_rows(spark, small_tasks, pairs):
    small_tasks()
    m = shop(spark)
    tasks = m.order_tasks()
    assert tasks == -(-m.order_items.count() // 40) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert _partitions(pairs(m), "order_id") == {tasks}
    assert pairs(m).rdd.getNumPartitions() == tasks


MARTS = [sellers.seller_mart, lambda m: products.product_mart(m, with_freight=True), order_review_stats, *PAIRS]


@pytest.mark.parametrize("hot", [190, 50])
@pytest.mark.parametrize("run", MARTS)
def test_results_are_those_of_the_sessions_partitions(spark, small_tasks, run, hot):
    was = run(shop(spark))
    schema, was = was.dtypes, _rows(was)
    assert was
    small_tasks(hot)
    m = shop(spark)
    for table in ("order_items", "order_reviews"):
        assert bool(m.hot(table, "order_id").pieces) == (hot == 50)
    now = run(m)
    assert now.dtypes == schema and _rows(now) == was


@pytest.mark.parametrize("hot", [190, 50])
@pytest.mark.parametrize("spec", [SELLERS, PRODUCTS], ids=["sellers", "products"])
def test_refreshed_in_many_tasks(spark, small_tasks, spec, hot):
    m = shop(spark)
    now = replace(
        m,
        order_items=m.order_items.filter("order_id is null or order_item_id % 8 != 3"),
        orders=m.orders.withColumn("order_status", F.when(F.col("order_id") == "o1", "shipped").otherwise("delivered")),
    )
    whole = _rows(spec.finish(_built(spark, spec, now).totals(), now, DEFAULT_RATES))
    small_tasks(hot)
    store = _built(spark, spec, m)
    store.refresh(now, m.orders.select("order_id").union(m.order_items.select("order_id")))
    assert _rows(store.mart(now)) != [] and _rows(store.mart(now)) == whole
    pairs = store._current_pairs(store._read("pairs", range(2)), 2)
    assert _partitions(pairs, "order_id _salt") == {store._tasks("pairs", 2)}


def _built(spark, spec, m):
    store = MartStore(spark, shared_path(spark, "tasks-test"), spec)
    store.build(m)
    return store


def test_items_look_up_dates_in_the_given_tasks(spark, small_tasks):
    items = spark.range(200).selectExpr(
        "id % 90 as l_orderkey", "cast(id as int) as l_linenumber", "id as l_partkey", "id as l_suppkey",
        "1.5D as l_extendedprice", "0.05D as l_tax",
    )
    orders = spark.range(80).selectExpr("id as o_orderkey", "timestamp_ntz'2018-01-01' as o_orderdate")
    dated = star_order_items(items, orders, tasks=9)
    assert _partitions(dated, "o_orderkey") == _partitions(dated, "l_orderkey _salt") == {9}
    assert _rows(dated) == _rows(star_order_items(items, orders))
    # the lookup still goes where its column is not used
    assert "Join" not in dated.select("order_id")._jdf.queryExecution().optimizedPlan().toString()


def test_sketch_knows_the_rows(spark):
    df = spark.range(40_000).selectExpr("id % 7 as k", "id")
    assert sketch(df, ["k"], ["id"], 100)["k"].rows == 40_000
    assert abs(sketch(df, ["k"], ["id"], 1000)["k"].rows - 40_000) < 4_000
    assert sketch(df.limit(0), ["k"], ["id"])["k"].rows == 0


def test_tasks_by_rows(spark, small_tasks):
    small_tasks()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark, 40) is None and tasks_for(spark, 41) == parts
    assert tasks_for(spark, 40 * parts + 1) == parts + 1


@pytest.mark.parametrize("limit", [20, 10_000])
def test_spread_sums_equal_plain_sums(spark, limit):
    df = spark.range(900).selectExpr("if(id < 500, 1, id) as k", "id as v")
    sums = [F.sum("v").alias("s"), F.count("v").alias("n")]
    hot = sketch(df, ["k"], ["v"], limit)["k"]
    assert bool(hot.pieces) == (limit == 20)
    got = spread_sums(df, "k", sums, 9, ["v"], hot)
    assert got.rdd.getNumPartitions() == 9
    assert _rows(got) == _rows(df.groupBy("k").agg(*sums))
