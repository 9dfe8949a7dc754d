"""Rewritten plans against their naive join forms, both in Spark, on the
driver tables: fused marts vs joined per-feature operators, the semi-join
distance vs the link-table form, the weighted product wait vs the fan-out
mean, per-order review statistics vs pairs x reviews."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from souk.functions.expr import days_between, haversine_km
from souk.operators import link, orders, products, sellers
from souk.operators.geo import LAT, LNG, locate
from souk.registry import marketplace


@pytest.fixture(scope="module")
def m(spark):
    return marketplace(spark, SF_SMALL)


def _table(df, key):
    out = {}
    for r in df.collect():
        d = r.asDict()
        out[d.pop(key)] = d
    return out


def _same(a: dict, b: dict):
    assert a.keys() == b.keys()
    for k in a:
        for c, v in a[k].items():
            if isinstance(v, float):
                assert v == pytest.approx(b[k][c], rel=1e-9, abs=1e-9), (k, c)
            else:
                assert v == b[k][c], (k, c)


def test_fused_seller_mart_equals_joined_operators(m):
    naive = (
        sellers.seller_features(m)
        .join(sellers.delay_wait(m), "seller_id")
        .join(sellers.active_dates(m), "seller_id")
        .join(sellers.review_scores(m), "seller_id")
        .join(sellers.costs(m), "seller_id")
        .join(sellers.revenues(m), "seller_id")
        .join(sellers.profits(m), "seller_id")
        .join(sellers.quantity(m), "seller_id")
        .join(sellers.sales(m), "seller_id")
        .select(*sellers.SELLER_MART)
    )
    _same(_table(sellers.seller_mart(m), "seller_id"), _table(naive, "seller_id"))


def test_fused_product_mart_equals_joined_operators(m):
    naive = (
        products.product_features(m)
        .join(products.wait_time(m), "product_id")
        .join(products.price(m), "product_id")
        .join(products.review_scores(m), "product_id")
        .join(products.costs(m), "product_id")
        .join(products.revenues(m), "product_id")
        .join(products.profits(m), "product_id")
        .join(products.quantity(m), "product_id")
        .join(products.sales(m), "product_id")
        .select(*products.PRODUCT_MART)
    )
    _same(_table(products.product_mart(m), "product_id"), _table(naive, "product_id"))


def test_distance_equals_link_table_form(m):
    s = locate(m.sellers, "seller_zip_code_prefix", m.geolocation).select(
        "seller_id", "seller_zip_code_prefix", "seller_city", "seller_state",
        F.col(LAT).alias("lat_s"), F.col(LNG).alias("lng_s"))
    c = locate(m.customers, "customer_zip_code_prefix", m.geolocation).select(
        "customer_id", "customer_zip_code_prefix", "customer_city", "customer_state",
        F.col(LAT).alias("lat_c"), F.col(LNG).alias("lng_c"))
    rows = link.link_table(m).join(s, "seller_id").join(c, "customer_id").dropna(how="any")
    naive = rows.groupBy("order_id").agg(
        F.avg(haversine_km(F.col("lng_s"), F.col("lat_s"), F.col("lng_c"), F.col("lat_c")))
        .alias("distance_seller_customer"))
    _same(_table(orders.seller_customer_distance(m), "order_id"), _table(naive, "order_id"))


def test_product_wait_equals_fan_out_mean(m):
    wait = m.orders.filter(orders.is_delivered_col()).select(
        "order_id",
        days_between(F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date"))
        .alias("wait_time"))
    naive = (
        link.link_table(m).filter(F.col("product_id").isNotNull())
        .join(wait, "order_id")
        .groupBy("product_id").agg(F.avg("wait_time").alias("wait_time"))
    )
    _same(_table(products.wait_time(m), "product_id"), _table(naive, "product_id"))


def test_review_ratios_equal_pairs_times_reviews(m):
    pairs = m.order_items.filter(F.col("seller_id").isNotNull()).select(
        "order_id", "seller_id").distinct()
    naive = pairs.join(orders.review_flags(m), "order_id").groupBy("seller_id").agg(
        F.avg("dim_is_one_star").alias("share_of_one_stars"),
        F.avg("dim_is_five_star").alias("share_of_five_stars"),
        F.avg("review_score").alias("review_score"))
    _same(_table(sellers.review_scores(m), "seller_id"), _table(naive, "seller_id"))
