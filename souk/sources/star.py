"""Marketplace view of the driver's TPC-H-like star schema.

The driver tables carry no reviews, delivery dates or coordinates, so the
marketplace columns are derived deterministically from keys and dates
(FIXTURES.md, part 2). Every table stays a lazy projection of one scan:
only ``order_items`` looks up another table (the date of its order), and the
``nation``/``region`` dimensions have a fixed size (25 and 5 rows), so they
are broadcast.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.plans.skew import in_tasks, salted_join, tasks_for
from souk.sources.catalog import GEO_ORDER, Marketplace
from souk.sources.schemas import MONEY

STAR_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plus(unit: str, amount: Column, ts: Column) -> Column:
    return F.timestamp_add(unit, amount.cast("int"), ts)


def _null_if(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation joined to its region name; 25 rows by construction."""
    region = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return nation.join(
        F.broadcast(region), nation.n_regionkey == region.r_regionkey, "left"
    ).select("n_nationkey", "n_name", "r_name")


def star_orders(raw: DataFrame) -> DataFrame:
    key, ts = F.col("o_orderkey"), F.col("o_orderdate")
    status = F.col("o_orderstatus")
    return raw.select(
        key.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(status.isin("F", "O"), "delivered").otherwise("shipped").alias("order_status"),
        ts.alias("order_purchase_timestamp"),
        _null_if(key % 97 == 0, _plus("HOUR", key % 48, ts)).alias("order_approved_at"),
        _null_if(key % 53 == 0, _plus("DAY", 1 + key % 6, ts)).alias(
            "order_delivered_carrier_date"
        ),
        _null_if(
            (key % 89 == 0) | ((status == "P") & (key % 11 != 0)),
            _plus("HOUR", 72 + (key * 7) % 700, ts),
        ).alias("order_delivered_customer_date"),
        _plus("DAY", 10 + (key * 13) % 20, ts).alias("order_estimated_delivery_date"),
    )


def star_order_items(lineitem: DataFrame, orders: DataFrame, tasks: int | None = None) -> DataFrame:
    """Items; the shipping limit needs the date of the item's order.

    The lookup is a left join to one row per order key (an aggregate on
    the key, so the optimizer knows the key is unique): the optimizer
    removes it altogether from every query that does not use
    ``shipping_limit_date``. Where it is used, an order holding a large
    share of all items is split over several tasks (``salted_join``), and the
    lookup is dealt out over ``tasks`` partitions.
    """
    dates = in_tasks(orders, tasks, "o_orderkey").groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(
        F.min("o_orderdate").alias("o_orderdate")
    )
    dated = salted_join(
        lineitem, dates, "l_orderkey", "left",
        spread_by=["l_linenumber", "l_partkey", "l_suppkey"], other_unique=True, tasks=tasks,
    )
    line = F.col("l_linenumber")
    price = F.floor("l_extendedprice").cast("bigint") * F.lit(Decimal("0.007")).cast(
        "decimal(4,3)"
    )
    return dated.select(
        F.col("l_orderkey").alias("order_id"),
        line.alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        _plus("DAY", 1 + line % 5, F.col("o_orderdate")).alias("shipping_limit_date"),
        price.cast(MONEY).alias("price"),
        F.round(F.col("l_tax") * 100).cast("int").cast(MONEY).alias("freight_value"),
    )


def star_order_reviews(orders: DataFrame) -> DataFrame:
    """10 % of orders get no review, 10 % get two (k = 0, 1)."""
    key, prio = F.col("o_orderkey"), F.col("o_orderpriority")
    k = F.explode(
        F.when(key % 10 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    ).alias("k")
    reviewed = orders.filter(key % 10 != 0).select("o_orderkey", "o_orderpriority", k)
    kk = F.col("k")
    return reviewed.select(
        (key * 2 + kk).alias("review_id"),
        key.alias("order_id"),
        F.when(kk == 0, F.substring(prio, 1, 1).try_cast("int"))
        .otherwise((1 + key % 5).cast("int"))
        .alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"),
        _null_if(key % 3 == 0, prio).alias("review_comment_message"),
        F.lit(None).cast("timestamp_ntz").alias("review_creation_date"),
        F.lit(None).cast("timestamp_ntz").alias("review_answer_timestamp"),
    )


def star_geolocation(places: DataFrame) -> DataFrame:
    """Three points per nation (k = 0, 1, 2); nation 13 has none."""
    n = F.col("n_nationkey")
    pts = places.filter(n != 13).select(
        "n_nationkey", "n_name", "r_name",
        F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"),
    )
    k = F.col("k")
    return pts.select(
        n.alias("geolocation_zip_code_prefix"),
        (F.lit(-30.0) + n + k * 0.25).cast("double").alias("geolocation_lat"),
        (F.lit(-60.0) + (n * 7) % 25 + k * 0.25).cast("double").alias("geolocation_lng"),
        F.col("n_name").alias("geolocation_city"),
        F.col("r_name").alias("geolocation_state"),
        (n * 3 + k).cast("bigint").alias(GEO_ORDER),
    )


def _located(entities: DataFrame, nation_key: str, places: DataFrame) -> DataFrame:
    return entities.join(
        F.broadcast(places), entities[nation_key] == places.n_nationkey, "left"
    )


def star_sellers(supplier: DataFrame, places: DataFrame) -> DataFrame:
    return _located(supplier, "s_nationkey", places).select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_nationkey").alias("seller_zip_code_prefix"),
        F.col("n_name").alias("seller_city"),
        F.col("r_name").alias("seller_state"),
    )


def star_customers(customer: DataFrame, places: DataFrame) -> DataFrame:
    return _located(customer, "c_nationkey", places).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_custkey").alias("customer_unique_id"),
        F.col("c_nationkey").alias("customer_zip_code_prefix"),
        F.col("n_name").alias("customer_city"),
        F.col("r_name").alias("customer_state"),
    )


def star_products(part: DataFrame) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return part.select(
        key.alias("product_id"),
        _null_if(key % 41 == 0, F.col("p_type")).alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        F.length("p_type").alias("product_description_lenght"),
        (size % 6).alias("product_photos_qty"),
        (size * 100).alias("product_weight_g"),
        (size + 10).alias("product_length_cm"),
        (size % 7 + 2).alias("product_height_cm"),
        (size % 9 + 5).alias("product_width_cm"),
    )


def star_translation(part: DataFrame) -> DataFrame:
    """One English name per category; 'PROMO' is left untranslated."""
    return (
        part.filter(F.col("p_type") != "PROMO")
        .select(
            F.col("p_type").alias("product_category_name"),
            F.lower("p_type").alias("product_category_name_english"),
        )
        .distinct()
    )


def load_star_marketplace(spark: SparkSession, sf_dir: str) -> Marketplace:
    """Marketplace over ``{sf_dir}/{table}.parquet`` (lazy; only the rows of
    ``orders`` and ``lineitem`` are counted, from the files' footers)."""
    places = _places(spark, sf_dir)
    orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")
    part = _read(spark, sf_dir, "part")
    tasks = tasks_for(spark, max(orders.count(), lineitem.count()))
    return Marketplace(
        orders=star_orders(orders),
        order_items=star_order_items(lineitem, orders, tasks),
        order_reviews=star_order_reviews(orders),
        customers=star_customers(_read(spark, sf_dir, "customer"), places),
        sellers=star_sellers(_read(spark, sf_dir, "supplier"), places),
        products=star_products(part),
        geolocation=star_geolocation(places),
        category_translation=star_translation(part),
    )
