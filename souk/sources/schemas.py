"""Declared schemas of the nine marketplace tables.

Nothing is inferred at scan time: every table has a fixed ``StructType``.
Timestamps are wall-clock values without a zone (``TIMESTAMP_NTZ``), which
keeps every day/month difference independent of the session time zone.
Money is ``decimal(18,3)`` so sums are exact and order-independent.
Keys are typed as strings here (the CSV files carry hashed ids); operators
never depend on the key type, and the star-schema adapter uses integers.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DecimalType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

MONEY = DecimalType(18, 3)


def _schema(*cols: tuple[str, object]) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in cols])


CUSTOMERS = _schema(
    ("customer_id", StringType()),
    ("customer_unique_id", StringType()),
    ("customer_zip_code_prefix", StringType()),
    ("customer_city", StringType()),
    ("customer_state", StringType()),
)

GEOLOCATION = _schema(
    ("geolocation_zip_code_prefix", StringType()),
    ("geolocation_lat", DoubleType()),
    ("geolocation_lng", DoubleType()),
    ("geolocation_city", StringType()),
    ("geolocation_state", StringType()),
)

ORDER_ITEMS = _schema(
    ("order_id", StringType()),
    ("order_item_id", IntegerType()),
    ("product_id", StringType()),
    ("seller_id", StringType()),
    ("shipping_limit_date", TimestampNTZType()),
    ("price", MONEY),
    ("freight_value", MONEY),
)

ORDER_PAYMENTS = _schema(
    ("order_id", StringType()),
    ("payment_sequential", IntegerType()),
    ("payment_type", StringType()),
    ("payment_installments", IntegerType()),
    ("payment_value", MONEY),
)

ORDER_REVIEWS = _schema(
    ("review_id", StringType()),
    ("order_id", StringType()),
    ("review_score", IntegerType()),
    ("review_comment_title", StringType()),
    ("review_comment_message", StringType()),
    ("review_creation_date", TimestampNTZType()),
    ("review_answer_timestamp", TimestampNTZType()),
)

ORDERS = _schema(
    ("order_id", StringType()),
    ("customer_id", StringType()),
    ("order_status", StringType()),
    ("order_purchase_timestamp", TimestampNTZType()),
    ("order_approved_at", TimestampNTZType()),
    ("order_delivered_carrier_date", TimestampNTZType()),
    ("order_delivered_customer_date", TimestampNTZType()),
    ("order_estimated_delivery_date", TimestampNTZType()),
)

# The source file spells two columns "lenght"; the product features fix it.
PRODUCTS = _schema(
    ("product_id", StringType()),
    ("product_category_name", StringType()),
    ("product_name_lenght", IntegerType()),
    ("product_description_lenght", IntegerType()),
    ("product_photos_qty", IntegerType()),
    ("product_weight_g", IntegerType()),
    ("product_length_cm", IntegerType()),
    ("product_height_cm", IntegerType()),
    ("product_width_cm", IntegerType()),
)

SELLERS = _schema(
    ("seller_id", StringType()),
    ("seller_zip_code_prefix", StringType()),
    ("seller_city", StringType()),
    ("seller_state", StringType()),
)

CATEGORY_TRANSLATION = _schema(
    ("product_category_name", StringType()),
    ("product_category_name_english", StringType()),
)

# Table key (see ``catalog.table_key``) -> schema.
TABLE_SCHEMAS: dict[str, StructType] = {
    "customers": CUSTOMERS,
    "geolocation": GEOLOCATION,
    "order_items": ORDER_ITEMS,
    "order_payments": ORDER_PAYMENTS,
    "order_reviews": ORDER_REVIEWS,
    "orders": ORDERS,
    "products": PRODUCTS,
    "sellers": SELLERS,
    "product_category_name_translation": CATEGORY_TRANSLATION,
}

# Tables whose text columns may hold quoted newlines; only these are read
# with the non-splittable multi-line CSV parser.
MULTILINE_TABLES = frozenset({"order_reviews"})
