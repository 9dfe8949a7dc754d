"""Seller mart and seller unit economics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.expr import (
    active_months,
    late_micros,
    mean_days,
    micros_between,
    micros_sums,
    resum,
)
from souk.operators.economics import DEFAULT_RATES, Rates
from souk.operators.geo import LAT, LNG, first_point
from souk.operators.orders import is_delivered_col, order_features
from souk.operators.reviews import order_review_stats, review_means
from souk.plans.skew import merged, pieces_of, salted_join
from souk.session import ensure_checkpoint_dir
from souk.sources.catalog import Marketplace

SELLER_MART = (
    "seller_id", "seller_city", "seller_state", LAT, LNG,
    "delay_to_carrier", "wait_time", "date_first_sale", "date_last_sale",
    "active_months", "share_of_one_stars", "share_of_five_stars",
    "review_score", "costs", "revenues", "profits", "n_orders", "quantity",
    "quantity_per_order", "sales",
)


# Columns that tell the items of one order apart (to split a hot order).
ITEM_SPREAD = ["seller_id", "order_item_id", "product_id"]


def _seller_items(m: Marketplace) -> DataFrame:
    return m.order_items.filter(F.col("seller_id").isNotNull())


def seller_features(m: Marketplace, legacy: bool = False) -> DataFrame:
    """Distinct seller rows with the first geolocation point of their city
    (city name only: homonym cities share a point). ``legacy``: the
    superseded form, seller rows as they are without any location."""
    if legacy:
        return m.sellers.select("seller_id", "seller_city", "seller_state")
    points = first_point(m.geolocation, "geolocation_city").withColumnRenamed(
        "geolocation_city", "seller_city"
    )
    return salted_join(
        m.sellers.dropDuplicates(), points, "seller_city", "left",
        spread_by=["seller_id", "seller_state"], other_unique=True, hot=m.hot("sellers", "seller_city"),
    ).select("seller_id", "seller_city", "seller_state", LAT, LNG)


def delay_wait(m: Marketplace, legacy: bool = False) -> DataFrame:
    """Per seller over item rows of delivered orders: mean days handed to
    the carrier after the shipping limit (early or unknown counts as 0) and
    mean customer wait (unknown skipped). ``legacy``: all statuses."""
    orders = m.orders
    if not legacy:
        orders = orders.filter(is_delivered_col())
    ship = salted_join(_seller_items(m), orders, "order_id", spread_by=ITEM_SPREAD, hot=m.hot("order_items", "order_id"))
    delay = late_micros(F.col("shipping_limit_date"), F.col("order_delivered_carrier_date"))
    wait = micros_between(
        F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
    )
    sums = ship.groupBy("seller_id").agg(
        *micros_sums(delay, "delay"), F.count(delay).alias("n_delay"),
        *micros_sums(wait, "wait"), F.count(wait).alias("n_wait"),
    )
    return sums.select(
        "seller_id",
        mean_days("delay", F.col("n_delay")).alias("delay_to_carrier"),
        mean_days("wait", F.col("n_wait")).alias("wait_time"),
    )


def active_dates(m: Marketplace, legacy: bool = False) -> DataFrame:
    """Per seller: first and last approval date of its orders (any status)
    and the number of started average months in between.

    ``legacy``: purchase dates instead of approval dates, no month count.
    """
    when = "order_purchase_timestamp" if legacy else "order_approved_at"
    dated = (
        salted_join(
            _seller_items(m).select("order_id", *ITEM_SPREAD),
            m.orders.select("order_id", when), "order_id", spread_by=ITEM_SPREAD,
            hot=m.hot("order_items", "order_id"),
        )
        .groupBy("seller_id")
        .agg(F.min(when).alias("date_first_sale"), F.max(when).alias("date_last_sale"))
    )
    if legacy:
        return dated
    return dated.withColumn(
        "active_months", active_months(F.col("date_first_sale"), F.col("date_last_sale"))
    )


def _pairs(m: Marketplace, entity: str) -> DataFrame:
    """Distinct (order, entity) pairs of the items, entity not NULL."""
    return (
        m.order_items.filter(F.col(entity).isNotNull() & F.col("order_id").isNotNull())
        .select("order_id", entity)
        .distinct()
    )


def _pair_reviews(m: Marketplace, entity: str, rates: Rates) -> DataFrame:
    """(order, entity) pairs with the review statistics of their order;
    pairs of orders without reviews are dropped."""
    return salted_join(_pairs(m, entity), order_review_stats(m, rates), "order_id",
                       spread_by=[entity], hot=m.hot("order_items", "order_id"))


def review_scores(m: Marketplace, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """Per seller, over (order, seller) pairs x reviews: share of one-star
    and five-star reviews and mean score."""
    return (
        _pair_reviews(m, "seller_id", rates)
        .groupBy("seller_id")
        .agg(*review_means())
    )


def quantity_sales(m: Marketplace, legacy: bool = False) -> DataFrame:
    """Per seller: n_orders (distinct orders), quantity (item rows),
    quantity_per_order and sales (sum of prices, 0 if all NULL), in one
    aggregate. ``legacy`` counts items with a product id instead of rows."""
    counted = F.col("product_id") if legacy else F.col("order_id")
    return (
        _seller_items(m)
        .groupBy("seller_id")
        .agg(
            F.count_distinct("order_id").alias("n_orders"),
            F.count(counted).alias("quantity"),
            F.coalesce(F.sum("price"), F.lit(0)).alias("_sales"),
        )
        .select(
            "seller_id",
            "n_orders",
            "quantity",
            F.try_divide(F.col("quantity"), F.col("n_orders")).alias("quantity_per_order"),
            F.col("_sales").cast("double").alias("sales"),
            F.col("_sales"),
        )
    )


def quantity(m: Marketplace) -> DataFrame:
    return quantity_sales(m).select("seller_id", "n_orders", "quantity", "quantity_per_order")


def sales(m: Marketplace) -> DataFrame:
    return quantity_sales(m).select("seller_id", "sales")


def _commission(sales_decimal: Column, rates: Rates) -> Column:
    return (sales_decimal * F.lit(rates.commission)).cast("double")


def revenues(m: Marketplace, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """Per seller with sales: commission on sales plus the subscription for
    each active month (NULL when the seller has no dated order)."""
    months = active_dates(m).select("seller_id", "active_months")
    return (
        quantity_sales(m)
        .join(months, "seller_id", "left")
        .select(
            "seller_id",
            (
                _commission(F.col("_sales"), rates)
                + F.lit(rates.subscription_per_month) * F.col("active_months")
            ).alias("revenues"),
        )
    )


def _it_cost(n_orders: DataFrame, rates: Rates) -> Column:
    """The denominator is a scalar subquery over all sellers, computed once
    (never a global window, which would run on one partition)."""
    total = n_orders.agg(F.sum(F.sqrt("n_orders"))).scalar()
    return F.sqrt("n_orders") * (F.lit(rates.it_total) / total)


def it_costs(n_orders: DataFrame, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """IT cost per seller: the IT total shared in proportion to
    sqrt(n_orders)."""
    return n_orders.select("seller_id", _it_cost(n_orders, rates).alias("it_costs"))


def costs(m: Marketplace, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """Per seller with at least one review: review costs plus IT cost."""
    review = (
        _pair_reviews(m, "seller_id", rates)
        .groupBy("seller_id")
        .agg(F.sum("seller_review_cost").alias("review_costs"))
    )
    it = it_costs(quantity_sales(m).select("seller_id", "n_orders"), rates)
    return review.join(it, "seller_id").select(
        "seller_id", (F.col("it_costs") + F.col("review_costs")).alias("costs")
    )


def profits(m: Marketplace, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """Revenues minus costs, matched by seller (sellers without reviews
    have no cost and no profit)."""
    return revenues(m, rates).join(costs(m, rates), "seller_id").select(
        "seller_id", (F.col("revenues") - F.col("costs")).alias("profits")
    )


def pair_sums(m: Marketplace, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """Per (order, seller) with items: the sums behind every seller-mart feature.

    Item rows are joined to one per-order row (the order and its review
    statistics; an order holding a large share of the items is split over
    several tasks) and aggregated, partially on the map side first.
    """
    orders = m.orders.select(
        "order_id", "order_status", "order_purchase_timestamp", "order_approved_at",
        "order_delivered_carrier_date", "order_delivered_customer_date",
        F.lit(True).alias("_dated"),
    )
    tasks = m.order_tasks()
    per_order = orders.join(order_review_stats(m, rates), "order_id", "full")
    items = _seller_items(m).select(
        "order_id", "seller_id", "price", "shipping_limit_date", "order_item_id", "product_id"
    )
    rows = salted_join(
        items, per_order, "order_id", "left",
        spread_by=ITEM_SPREAD, hot=m.hot("order_items", "order_id"),
        tasks=tasks, keep_salt=bool(tasks),
    )
    delivered = F.coalesce(F.col("_dated") & is_delivered_col(), F.lit(False))
    wait = micros_between(
        F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
    )
    delay = late_micros(F.col("shipping_limit_date"), F.col("order_delivered_carrier_date"))
    of_order = ("n_reviews", "n_one_star", "n_two_star", "n_three_star", "n_five_star",
                "score_sum", "n_scored", "seller_review_cost")
    pair = ["order_id", "seller_id"]
    sums = rows.groupBy(*pair, *pieces_of(rows)).agg(
        F.count("order_id").alias("n_items"),
        F.sum("price").alias("price_sum"),
        F.count_if(F.col("_dated")).alias("n_dated"),
        F.count_if(delivered).alias("n_delivered"),
        *micros_sums(F.when(delivered, delay), "delay"),
        *micros_sums(F.when(delivered, wait), "wait"),
        F.count(F.when(delivered, wait)).alias("n_wait"),
        F.min("order_approved_at").alias("first_approved"),
        F.max("order_approved_at").alias("last_approved"),
        *[F.max(c).alias(c) for c in of_order],
    )
    return merged(sums, pair, tasks, least=("first_approved",), most=("last_approved", *of_order))


def seller_aggregates(m: Marketplace, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """Per seller with items: the sums of ``pair_sums``."""
    return pair_sums(m, rates).groupBy("seller_id").agg(
        F.count("order_id").alias("n_orders"),
        F.sum("n_items").alias("quantity"),
        F.coalesce(F.sum("price_sum"), F.lit(0)).alias("_sales"),
        F.sum("n_delivered").alias("_n_delivered"),
        *resum("delay"),
        *resum("wait"),
        F.sum("n_wait").alias("_n_wait"),
        F.min("first_approved").alias("date_first_sale"),
        F.max("last_approved").alias("date_last_sale"),
        F.sum("n_reviews").alias("_n_reviews"),
        *review_means(),
        F.sum("seller_review_cost").alias("_review_costs"),
    )


def seller_mart(m: Marketplace, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """Seller mart (20 columns, see ``SELLER_MART``), for sellers that have
    a delivered item and at least one review.

    One pass instead of nine joined marts (``seller_aggregates``): every
    seller feature is a ratio of sums of per-(order, seller) rows.
    """
    per_seller = seller_aggregates(m, rates)
    # The per-seller table (one row per seller) feeds both the mart rows and
    # the IT-cost denominator over all sellers; a checkpoint computes it once
    # (otherwise each use re-reads the items) and cuts the lineage.
    ensure_checkpoint_dir(per_seller.sparkSession)
    return mart_of(per_seller.checkpoint(eager=True), m, rates)


def mart_of(per_seller: DataFrame, m: Marketplace, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """The seller mart from the per-seller sums of ``seller_aggregates``."""
    revenue = _commission(F.col("_sales"), rates) + F.lit(
        rates.subscription_per_month
    ) * F.col("active_months")
    cost = _it_cost(per_seller, rates) + F.col("_review_costs")
    mart = (
        per_seller.filter((F.col("_n_delivered") > 0) & (F.col("_n_reviews") > 0))
        .withColumns(
            {
                "delay_to_carrier": mean_days("delay", F.col("_n_delivered")),
                "wait_time": mean_days("wait", F.col("_n_wait")),
                "active_months": active_months(
                    F.col("date_first_sale"), F.col("date_last_sale")
                ),
                "costs": cost,
                "quantity_per_order": F.try_divide(F.col("quantity"), F.col("n_orders")),
                "sales": F.col("_sales").cast("double"),
            }
        )
        .withColumn("revenues", revenue)
        .withColumn("profits", F.col("revenues") - F.col("costs"))
    )
    return seller_features(m).join(mart, "seller_id").select(*SELLER_MART)


def legacy_review_scores(m: Marketplace) -> DataFrame:
    """Superseded seller review score: order mart rows (delivered, complete)
    beside every item row, so each review weighs by the seller's items in the
    order. Built from one row of sums per order and one item count per
    (order, seller); no review x item rows."""
    per_order = order_features(m).groupBy("order_id").agg(
        F.sum("dim_is_five_star").alias("_five"),
        F.sum("dim_is_one_star").alias("_one"),
        F.count(F.lit(1)).alias("_rows"),
        F.sum("review_score").alias("_score"),
        F.count("review_score").alias("_scored"),
    )
    items = _seller_items(m).groupBy("order_id", "seller_id").agg(F.count(F.lit(1)).alias("_items"))

    def weighted(name: str) -> Column:
        return F.sum(F.col("_items") * F.col(name))

    return (
        salted_join(items, per_order, "order_id", spread_by=["seller_id"], hot=m.hot("order_items", "order_id"))
        .groupBy("seller_id")
        .agg(
            F.try_divide(weighted("_five"), weighted("_rows")).alias("share_of_five_stars"),
            F.try_divide(weighted("_one"), weighted("_rows")).alias("share_of_one_stars"),
            F.try_divide(weighted("_score"), weighted("_scored")).alias("review_score"),
        )
    )


LEGACY_SELLER_MART = (
    "seller_id", "seller_city", "seller_state", "delay_to_carrier", "wait_time",
    "date_first_sale", "date_last_sale", "share_of_five_stars",
    "share_of_one_stars", "review_score", "n_orders", "quantity",
    "quantity_per_order", "sales",
)


def legacy_seller_mart(m: Marketplace) -> DataFrame:
    """Superseded seller mart: six inner joins, then rows with a NULL
    dropped; no location, no economics."""
    qs = quantity_sales(m, legacy=True).select(
        "seller_id", "n_orders", "quantity", "quantity_per_order", "sales"
    )
    return (
        seller_features(m, legacy=True)
        .join(delay_wait(m, legacy=True), "seller_id")
        .join(active_dates(m, legacy=True), "seller_id")
        .join(legacy_review_scores(m), "seller_id")
        .join(qs, "seller_id")
        .select(*LEGACY_SELLER_MART)
        .dropna(how="any")
    )
