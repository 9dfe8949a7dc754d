"""Marts kept by refreshes, replayed over the catalog: an earlier state of the
orders is built, then everything that changed since is refreshed."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.operators.incremental import PRODUCTS, SELLERS, MartSpec, MartStore
from souk.plans.skew import in_tasks
from souk.sources.catalog import Marketplace
from souk.sources.export import shared_path


def earlier(m: Marketplace) -> Marketplace:
    """The marketplace before its last changes: a fifth of the orders (but not
    their items), some items and a third of the reviews are still to come,
    some orders are not delivered yet, and some items stand with another
    seller, product and price."""
    key = F.col("order_id")
    undelivered, other = key % 7 == 0, key % 13 == 0
    orders = m.orders.filter(key % 5 != 0).withColumns(
        {
            "order_status": F.when(undelivered, "shipped").otherwise(F.col("order_status")),
            "order_delivered_customer_date": F.when(~undelivered, F.col("order_delivered_customer_date")),
            "order_approved_at": F.when(
                key % 17 == 0, F.timestamp_add("YEAR", F.lit(-9), F.col("order_approved_at"))
            ).otherwise(F.col("order_approved_at")),
        }
    )
    price = F.col("price")
    items = m.order_items.filter(~((key % 11 == 0) & (F.col("order_item_id") == 1))).withColumns(
        {
            "seller_id": F.when(other, F.col("seller_id") + 1).otherwise(F.col("seller_id")),
            "product_id": F.when(other, F.col("product_id") + 1).otherwise(F.col("product_id")),
            "price": F.when(other, price + price).otherwise(price).cast(m.order_items.schema["price"].dataType),
        }
    )
    return replace(m, orders=orders, order_items=items, order_reviews=m.order_reviews.filter(F.col("review_id") % 3 != 0))


def changed_orders(m: Marketplace) -> DataFrame:
    """The orders that ``earlier`` has otherwise."""
    key, some = F.col("order_id"), F.lit(False)
    for k in (5, 7, 11, 13, 17):
        some = some | (key % k == 0)
    late = m.order_reviews.filter(F.col("review_id") % 3 == 0).select("order_id")
    ids = m.orders.filter(some).select("order_id").unionByName(late)
    return in_tasks(ids, m.order_tasks(), "order_id").distinct()


def refreshed(m: Marketplace, spec: MartSpec) -> DataFrame:
    spark = m.orders.sparkSession
    store = MartStore(spark, shared_path(spark, "mart"), spec)
    store.build(earlier(m))
    store.refresh(m, changed_orders(m))
    return store.mart(m)


def refreshed_seller_mart(m: Marketplace) -> DataFrame:
    return refreshed(m, SELLERS)


def refreshed_product_mart(m: Marketplace) -> DataFrame:
    return refreshed(m, PRODUCTS)
