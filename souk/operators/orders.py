"""Order mart: one row per (order, review) with delivery, review, basket and
distance features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.expr import (
    days_between,
    haversine_km,
    late_days,
    late_days_keep_null,
    score_flag,
)
from souk.operators.geo import LAT, LNG, locate
from souk.plans.skew import salted_join
from souk.sources.catalog import Marketplace

DELIVERED = "delivered"


def is_delivered_col() -> F.Column:
    return F.col("order_status") == DELIVERED


ORDER_FEATURES = (
    "order_id", "wait_time", "expected_wait_time", "delay_vs_expected",
    "order_status", "dim_is_five_star", "dim_is_one_star", "review_score",
    "number_of_products", "number_of_sellers", "price", "freight_value",
)


def wait_time(m: Marketplace, is_delivered: bool = True, legacy: bool = False) -> DataFrame:
    """Per order: wait_time, expected_wait_time, delay_vs_expected (days).

    delay_vs_expected is the lateness against the estimate, 0 when early or
    when the delivery date is unknown. ``legacy`` is the superseded rule:
    always delivered-only, and an unknown delivery date keeps a NULL delay.
    """
    o = m.orders
    if is_delivered or legacy:
        o = o.filter(is_delivered_col())
    purchase = F.col("order_purchase_timestamp")
    delivered = F.col("order_delivered_customer_date")
    estimated = F.col("order_estimated_delivery_date")
    lateness = late_days_keep_null if legacy else late_days
    return o.select(
        "order_id",
        days_between(purchase, delivered).alias("wait_time"),
        days_between(purchase, estimated).alias("expected_wait_time"),
        lateness(estimated, delivered).alias("delay_vs_expected"),
        "order_status",
    )


def review_flags(m: Marketplace) -> DataFrame:
    """Per review row: order_id, five/one-star flags (0/1), review_score."""
    score = F.col("review_score")
    return m.order_reviews.select(
        "order_id",
        score_flag(score, 5).alias("dim_is_five_star"),
        score_flag(score, 1).alias("dim_is_one_star"),
        score,
    )


def basket(m: Marketplace, legacy: bool = False) -> DataFrame:
    """Per order with items: number_of_products, number_of_sellers, price,
    freight_value, in one aggregate (one shuffle of the items).

    number_of_products counts item rows; ``legacy`` takes the largest item
    number instead (superseded rule). Money sums are exact decimals (0 when
    every price is NULL) returned as double.
    """
    n_products = F.max("order_item_id") if legacy else F.count("order_item_id")
    return (
        m.order_items.filter(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(
            n_products.alias("number_of_products"),
            F.count_distinct("seller_id").alias("number_of_sellers"),
            F.coalesce(F.sum("price"), F.lit(0)).cast("double").alias("price"),
            F.coalesce(F.sum("freight_value"), F.lit(0)).cast("double").alias("freight_value"),
        )
    )


def number_of_products(m: Marketplace, legacy: bool = False) -> DataFrame:
    return basket(m, legacy).select("order_id", "number_of_products")


def number_of_sellers(m: Marketplace) -> DataFrame:
    return basket(m).select("order_id", "number_of_sellers")


def price_and_freight(m: Marketplace) -> DataFrame:
    return basket(m).select("order_id", "price", "freight_value")


def seller_customer_distance(m: Marketplace) -> DataFrame:
    """Mean seller-to-customer haversine distance (km) per order.

    Semantics of the link-table form: every (review, item) row of an order
    whose review id, product, seller and customer location are all known
    contributes one distance. The review fan-out is the same for every item
    of an order, so it cancels in the mean: the plan joins items to sellers
    and orders to customers and only checks that a review exists (semi
    join), never materialising the (review x item) product.
    """
    def known(df: DataFrame, cols: list[str]) -> DataFrame:
        return df.dropna(how="any", subset=cols)

    sellers = known(
        locate(m.sellers, "seller_zip_code_prefix", m.geolocation, m.hot("sellers", "seller_zip_code_prefix")),
        ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state", LAT, LNG],
    ).select("seller_id", F.col(LAT).alias("lat_s"), F.col(LNG).alias("lng_s"))
    customers = known(
        locate(m.customers, "customer_zip_code_prefix", m.geolocation, m.hot("customers", "customer_zip_code_prefix")),
        ["customer_id", "customer_zip_code_prefix", "customer_city", "customer_state", LAT, LNG],
    ).select("customer_id", F.col(LAT).alias("lat_c"), F.col(LNG).alias("lng_c"))

    reviewed = (
        m.order_reviews.filter(F.col("review_id").isNotNull()).select("order_id").distinct()
    )
    orders = salted_join(
        m.orders.select("order_id", "customer_id").join(reviewed, "order_id", "left_semi"),
        customers, "customer_id", spread_by=["order_id"], hot=m.hot("orders", "customer_id"),
    )
    items = salted_join(
        m.order_items.filter(F.col("product_id").isNotNull()).select(
            "order_id", "seller_id", "order_item_id", "product_id"
        ),
        sellers, "seller_id", spread_by=["order_id", "order_item_id", "product_id"],
        hot=m.hot("order_items", "seller_id"),
    )
    dist = haversine_km(F.col("lng_s"), F.col("lat_s"), F.col("lng_c"), F.col("lat_c"))
    return (
        salted_join(items, orders, "order_id",
                    spread_by=["seller_id", "order_item_id", "product_id"], hot=m.hot("order_items", "order_id"))
        .groupBy("order_id")
        .agg(F.avg(dist).alias("distance_seller_customer"))
    )


def order_features(
    m: Marketplace,
    is_delivered: bool = True,
    with_distance: bool = False,
    legacy: bool = False,
) -> DataFrame:
    """Order mart, one row per (order, review), rows with any NULL dropped.

    Review rows are joined to one per-order row (wait times, basket and
    distance, all keyed on order_id); an order with very many reviews is split over
    several tasks. ``legacy`` combines the superseded wait time and product
    count (both arguments are then ignored, as before).
    """
    if legacy:
        is_delivered, with_distance = True, False
    cols = list(ORDER_FEATURES)
    per_order = wait_time(m, is_delivered, legacy=legacy).join(
        basket(m, legacy=legacy), "order_id"
    )
    if with_distance:
        per_order = per_order.join(seller_customer_distance(m), "order_id")
        cols.append("distance_seller_customer")
    score = F.col("review_score")
    reviews = m.order_reviews.select(
        "order_id", "review_id",
        score_flag(score, 5).alias("dim_is_five_star"),
        score_flag(score, 1).alias("dim_is_one_star"),
        score,
    )
    mart = salted_join(reviews, per_order, "order_id", spread_by=["review_id", "review_score"],
                       hot=m.hot("order_reviews", "order_id"))
    return mart.select(*cols).dropna(how="any")
