"""Review-level operators: per-order review statistics (shared by the
seller and product marts) and the review features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.expr import review_cost, score_flag
from souk.operators.economics import DEFAULT_RATES, Rates
from souk.plans.skew import salted_join, spread_sums
from souk.sources.catalog import Marketplace


def order_review_stats(m: Marketplace, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """Per order: number of review rows, one/two/three/five-star counts, score sum and
    count of non-NULL scores, and the summed review cost for sellers and for
    products.

    Every mean "over (entity, order) pairs x reviews" is a ratio of sums of
    these columns, so marts join one row per order instead of fanning out to
    one row per review. An order with many reviews never reaches one reducer
    as many rows: the aggregate is partial (map-side) or, dealt out over
    ``Marketplace.order_tasks``, sums such an order in pieces.
    """
    score = F.col("review_score")
    s, p = rates.seller_review, rates.product_review
    return spread_sums(
        m.order_reviews.filter(F.col("order_id").isNotNull()),
        "order_id",
        [
            F.count(F.lit(1)).alias("n_reviews"),
            F.sum(score_flag(score, 1)).alias("n_one_star"),
            F.sum(score_flag(score, 2)).alias("n_two_star"),
            F.sum(score_flag(score, 3)).alias("n_three_star"),
            F.sum(score_flag(score, 5)).alias("n_five_star"),
            F.sum(score).alias("score_sum"),
            F.count(score).alias("n_scored"),
            F.sum(review_cost(score, s.low_base, s.mid)).alias("seller_review_cost"),
            F.sum(review_cost(score, p.low_base, p.mid)).alias("product_review_cost"),
        ],
        m.order_tasks(),
        spread_by=["review_id", "review_score"],
        hot=m.hot("order_reviews", "order_id"),
    )


def review_means(prefix: str = "") -> list:
    """Ratio-of-sums aggregates over rows carrying ``order_review_stats``."""
    def total(c: str):
        return F.sum(prefix + c)

    return [
        F.try_divide(total("n_one_star"), total("n_reviews")).alias("share_of_one_stars"),
        F.try_divide(total("n_five_star"), total("n_reviews")).alias("share_of_five_stars"),
        F.try_divide(total("score_sum"), total("n_scored")).alias("review_score"),
    ]


def bad_scores(m: Marketplace) -> DataFrame:
    """Data-quality check: review rows whose score is outside 1..5 (they
    cost nothing in the economics), counted per score value."""
    score = F.col("review_score")
    return (
        m.order_reviews.filter(score.isNotNull() & ~score.between(1, 5))
        .groupBy("review_score")
        .agg(F.count(F.lit(1)).alias("n_reviews"))
    )


def score_counts(m: Marketplace, lowest: int = 1, highest: int = 5) -> DataFrame:
    """Review rows per score, with whether the score is a valid one (NULL
    scores are a row of their own, not valid)."""
    score = F.col("review_score")
    return m.order_reviews.groupBy("review_score").agg(F.count(F.lit(1)).alias("n_reviews")).select(
        "review_score",
        "n_reviews",
        F.coalesce(score.between(lowest, highest), F.lit(False)).alias("is_valid"),
    )


def review_length(m: Marketplace) -> DataFrame:
    """Per review: length of the comment (0 when there is none)."""
    return m.order_reviews.select(
        "review_id",
        F.length(F.coalesce(F.col("review_comment_message"), F.lit(""))).alias("length_review"),
        "review_score",
    )


def main_product_category(m: Marketplace) -> DataFrame:
    """Per order: the category with most item rows; ties go to the larger
    price sum, then to the first category name.

    Two partial aggregates: (order, category) counts, then one row per order
    picked with ``min_by`` on a (-count, -price, name) key.
    """
    items = m.order_items.select("order_id", "product_id", "price", "order_item_id", "seller_id")
    cats = m.products.select("product_id", "product_category_name").filter(
        F.col("product_category_name").isNotNull()
    )
    per_cat = (
        salted_join(items, cats, "product_id", spread_by=["order_id", "order_item_id", "seller_id"],
                    hot=m.hot("order_items", "product_id"))
        .groupBy("order_id", "product_category_name")
        .agg(
            F.count(F.lit(1)).alias("n_items"),
            F.coalesce(F.sum("price"), F.lit(0)).alias("price_sum"),
        )
    )
    key = F.struct(-F.col("n_items"), -F.col("price_sum"), F.col("product_category_name"))
    return per_cat.groupBy("order_id").agg(
        F.min_by("product_category_name", key).alias("product_category")
    )


def review_category(m: Marketplace) -> DataFrame:
    """Per review row of an order with a categorised item: review_id,
    order_id and the main category of the order."""
    return salted_join(
        m.order_reviews.select("review_id", "order_id"), main_product_category(m),
        "order_id", spread_by=["review_id"], hot=m.hot("order_reviews", "order_id"),
    ).select("review_id", "order_id", "product_category")


def review_features(m: Marketplace) -> DataFrame:
    """Per review: review_id, order_id, comment length and main category of
    the reviewed order (NULL when the order has no categorised item)."""
    lengths = m.order_reviews.select(
        "review_id",
        "order_id",
        F.length(F.coalesce(F.col("review_comment_message"), F.lit(""))).alias(
            "review_comment_length"
        ),
    )
    return salted_join(
        lengths, main_product_category(m), "order_id", "left",
        spread_by=["review_id"], other_unique=True, hot=m.hot("order_reviews", "order_id"),
    ).select("review_id", "order_id", "review_comment_length", "product_category")
