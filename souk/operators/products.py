"""Product mart and product unit economics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.expr import mean_days, micros_between, micros_sums, resum
from souk.operators.economics import DEFAULT_RATES, Rates
from souk.operators.orders import is_delivered_col
from souk.operators.reviews import order_review_stats, review_means
from souk.plans.skew import merged, pieces_of, salted_join
from souk.sources.catalog import Marketplace

PRODUCT_FEATURES = (
    "product_id", "product_name_length", "product_description_length",
    "product_photos_qty", "product_weight_g", "product_length_cm",
    "product_height_cm", "product_width_cm", "category",
)
PRODUCT_MART = PRODUCT_FEATURES + (
    "wait_time", "price", "share_of_one_stars", "share_of_five_stars",
    "review_score", "costs", "revenues", "profits", "n_orders", "quantity", "sales",
)


def _product_items(m: Marketplace) -> DataFrame:
    return m.order_items.filter(F.col("product_id").isNotNull())


def product_features(m: Marketplace) -> DataFrame:
    """Products with an English category (others are dropped), with the
    misspelt length columns renamed."""
    return salted_join(
        m.products, m.category_translation, "product_category_name", spread_by=["product_id"],
        hot=m.hot("products", "product_category_name"),
    ).select(
        "product_id",
        F.col("product_name_lenght").alias("product_name_length"),
        F.col("product_description_lenght").alias("product_description_length"),
        "product_photos_qty", "product_weight_g", "product_length_cm",
        "product_height_cm", "product_width_cm",
        F.col("product_category_name_english").alias("category"),
    )


def _mean_price(price_sum: F.Column, n_priced: F.Column) -> F.Column:
    return F.try_divide(price_sum.cast("double"), n_priced)


def item_stats(m: Marketplace) -> DataFrame:
    """Per product, one aggregate of the items: mean price, n_orders
    (distinct orders), quantity (item rows) and sales (0 if all NULL)."""
    return (
        _product_items(m)
        .groupBy("product_id")
        .agg(
            _mean_price(F.sum("price"), F.count("price")).alias("price"),
            F.count_distinct("order_id").alias("n_orders"),
            F.count("order_id").alias("quantity"),
            F.coalesce(F.sum("price"), F.lit(0)).alias("_sales"),
        )
        .withColumn("sales", F.col("_sales").cast("double"))
    )


def price(m: Marketplace) -> DataFrame:
    return item_stats(m).select("product_id", "price")


def quantity(m: Marketplace) -> DataFrame:
    return item_stats(m).select("product_id", "n_orders", "quantity")


def sales(m: Marketplace) -> DataFrame:
    return item_stats(m).select("product_id", "sales")


def _review_weight() -> F.Column:
    # In the link-table form an item row appears once per review of its
    # order (once if there is none).
    return F.greatest(F.coalesce(F.col("n_reviews"), F.lit(0)), F.lit(1))


def wait_time(m: Marketplace) -> DataFrame:
    """Per product: mean customer wait over the link-table rows of its
    delivered orders, i.e. each item row weighted by max(reviews, 1).

    The weight is computed from per-order review counts, so the (review x
    item) rows are never materialised.
    """
    counts = order_review_stats(m).select("order_id", "n_reviews")
    delivered = m.orders.filter(is_delivered_col()).select(
        "order_id",
        micros_between(
            F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
        ).alias("wait_us"),
    )
    per_order = delivered.join(counts, "order_id", "left")
    rows = salted_join(
        _product_items(m).select("order_id", "product_id", "order_item_id", "seller_id"),
        per_order, "order_id", spread_by=["product_id", "order_item_id", "seller_id"],
        hot=m.hot("order_items", "order_id"),
    )
    w, wait = _review_weight(), F.col("wait_us")
    sums = rows.groupBy("product_id").agg(
        *micros_sums(wait, "wait", w), F.sum(F.when(wait.isNotNull(), w)).alias("n_wait")
    )
    return sums.select("product_id", mean_days("wait", F.col("n_wait")).alias("wait_time"))


def _pair_reviews(m: Marketplace, rates: Rates) -> DataFrame:
    pairs = (
        m.order_items.filter(F.col("product_id").isNotNull() & F.col("order_id").isNotNull())
        .select("order_id", "product_id")
        .distinct()
    )
    return salted_join(
        pairs, order_review_stats(m, rates), "order_id", spread_by=["product_id"],
        hot=m.hot("order_items", "order_id"),
    )


def review_scores(m: Marketplace, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """Per product, over (order, product) pairs x reviews: shares of one-
    and five-star reviews and mean score."""
    return _pair_reviews(m, rates).groupBy("product_id").agg(*review_means())


def costs(m: Marketplace, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """Per reviewed product: summed review costs."""
    return (
        _pair_reviews(m, rates)
        .groupBy("product_id")
        .agg(F.sum("product_review_cost").alias("costs"))
    )


def revenues(m: Marketplace, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """Per product: commission on sales (no subscription for products)."""
    return item_stats(m).select(
        "product_id",
        (F.col("_sales") * F.lit(rates.commission)).cast("double").alias("revenues"),
    )


def profits(m: Marketplace, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """Revenues minus costs, matched by product."""
    return revenues(m, rates).join(costs(m, rates), "product_id").select(
        "product_id", (F.col("revenues") - F.col("costs")).alias("profits")
    )


def product_mart(
    m: Marketplace, rates: Rates = DEFAULT_RATES, with_freight: bool = False
) -> DataFrame:
    """Product mart (20 columns, see ``PRODUCT_MART``) for translated
    products with a delivered item and at least one review.

    Same one-pass shape as the seller mart: items joined to one per-order
    row (order and review statistics, hot orders split), aggregated per
    (order, product), then per product. ``with_freight`` adds the mean
    freight value per item row.
    """
    return mart_of(_per_product(pair_sums(m, rates)), m, rates, with_freight)


def pair_sums(m: Marketplace, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """Per (order, product) with items: the sums behind every product-mart feature."""
    orders = m.orders.select(
        "order_id", "order_status", "order_purchase_timestamp",
        "order_delivered_customer_date",
    )
    tasks = m.order_tasks()
    per_order = orders.join(order_review_stats(m, rates), "order_id", "full")
    items = _product_items(m).select(
        "order_id", "product_id", "price", "freight_value", "order_item_id", "seller_id"
    )
    rows = salted_join(
        items, per_order, "order_id", "left",
        spread_by=["product_id", "order_item_id", "seller_id"], hot=m.hot("order_items", "order_id"),
        tasks=tasks, keep_salt=bool(tasks),
    )
    delivered = F.coalesce(is_delivered_col(), F.lit(False))
    wait = micros_between(
        F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
    )
    w = _review_weight()
    of_order = ("n_reviews", "n_one_star", "n_two_star", "n_three_star", "n_five_star",
                "score_sum", "n_scored", "product_review_cost")
    pair = ["order_id", "product_id"]
    sums = rows.groupBy(*pair, *pieces_of(rows)).agg(
        F.count("order_id").alias("n_items"),
        F.sum("price").alias("price_sum"),
        F.count("price").alias("n_priced"),
        F.sum("freight_value").alias("freight_sum"),
        F.count("freight_value").alias("n_freight"),
        F.count_if(delivered).alias("n_delivered"),
        *micros_sums(F.when(delivered, wait), "wait", w),
        F.sum(F.when(delivered & wait.isNotNull(), w)).alias("wait_w"),
        *[F.max(c).alias(c) for c in of_order],
    )
    return merged(sums, pair, tasks, most=of_order)


def _per_product(per_pair: DataFrame) -> DataFrame:
    return per_pair.groupBy("product_id").agg(
        *resum("wait"),
        F.sum("wait_w").alias("_wait_w"),
        _mean_price(F.sum("price_sum"), F.sum("n_priced")).alias("price"),
        *review_means(),
        F.sum("product_review_cost").alias("costs"),
        F.count("order_id").alias("n_orders"),
        F.sum("n_items").alias("quantity"),
        F.coalesce(F.sum("price_sum"), F.lit(0)).alias("_sales"),
        F.try_divide(F.sum("freight_sum").cast("double"), F.sum("n_freight")).alias(
            "freight_value"
        ),
        F.sum("n_delivered").alias("_n_delivered"),
        F.sum("n_reviews").alias("_n_reviews"),
    )


def mart_of(
    per_product: DataFrame, m: Marketplace, rates: Rates = DEFAULT_RATES, with_freight: bool = False
) -> DataFrame:
    """The product mart from per-product sums."""
    mart = (
        per_product.filter((F.col("_n_delivered") > 0) & (F.col("_n_reviews") > 0))
        .withColumn("wait_time", mean_days("wait", F.col("_wait_w")))
        .withColumn("revenues", (F.col("_sales") * F.lit(rates.commission)).cast("double"))
        .withColumn("profits", F.col("revenues") - F.col("costs"))
        .withColumn("sales", F.col("_sales").cast("double"))
    )
    cols = list(PRODUCT_MART) + (["freight_value"] if with_freight else [])
    return product_features(m).join(mart, "product_id").select(*cols)
