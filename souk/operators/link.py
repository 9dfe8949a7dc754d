"""Order / review / customer / product / seller link table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from souk.plans.skew import salted_join
from souk.sources.catalog import Marketplace

LINK_COLUMNS = ("customer_id", "order_id", "review_id", "product_id", "seller_id")
# Superseded column order (items first).
LEGACY_LINK_COLUMNS = ("order_id", "seller_id", "product_id", "review_id", "customer_id")


def link_table(m: Marketplace, legacy_order: bool = False) -> DataFrame:
    """orders FULL JOIN reviews FULL JOIN items on order_id.

    One row per (review or none) x (item or none) of every order id found in
    any of the three tables, so an order fans out to
    max(reviews, 1) * max(items, 1) rows.

    Each table is read once (and the two many-rows tables once more for their
    hot keys). A full outer sort-merge join sends all rows of an order to one
    task, so orders with very many reviews, or items, are split over several
    tasks on that side and their few rows of the other copied to each; of a
    copied row only matches stay, since a split order has rows to match.
    """
    orders = m.orders.select("order_id", "customer_id")
    reviews = m.order_reviews.select("order_id", "review_id")
    items = m.order_items.select("order_id", "product_id", "seller_id", "order_item_id")
    many_reviews = m.hot("order_reviews", "order_id")
    head = salted_join(reviews, orders, "order_id", "full", spread_by=["review_id"], hot=many_reviews)
    link = salted_join(
        items, head, "order_id", "full",
        spread_by=["product_id", "seller_id", "order_item_id"],
        other_spread_by=["review_id", "customer_id"],
        hot=m.hot("order_items", "order_id"), other_hot=many_reviews,
    )
    return link.select(*(LEGACY_LINK_COLUMNS if legacy_order else LINK_COLUMNS))
