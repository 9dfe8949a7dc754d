"""Registered queries: operator, DuckDB oracle and double columns.

Each query runs an operator over the marketplace view of the driver tables
(``souk.sources.star``) and canonicalises its doubles; ``oracle`` is the
naive SQL of the same query (None where no exact SQL exists).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from souk import oracle as sql
from souk.functions.canonical import canonical
from souk.operators import analysis, link, orders, products, replay, reviews, roundtrip, segments, sellers
from souk.sources.catalog import Marketplace
from souk.sources.star import load_star_marketplace


@dataclass(frozen=True)
class Query:
    run: Callable[[Marketplace], DataFrame]
    oracle: str | None
    doubles: tuple[str, ...] = ()


WAIT = ("wait_time", "expected_wait_time", "delay_vs_expected")
ORDER_DOUBLES = WAIT + ("price", "freight_value")
SELLER_MART_DOUBLES = (
    "geolocation_lat", "geolocation_lng", "delay_to_carrier", "wait_time", "active_months",
    "share_of_one_stars", "share_of_five_stars", "review_score", "costs", "revenues",
    "profits", "quantity_per_order", "sales",
)
REVIEW_MEANS = ("share_of_one_stars", "share_of_five_stars", "review_score")
PRODUCT_MART_DOUBLES = (
    "wait_time", "price", *REVIEW_MEANS, "costs", "revenues", "profits", "sales",
)


def _select(name: str, where: str = "") -> str:
    return f"SELECT * FROM {name} {where}"


def _not_null(name: str) -> str:
    return f"SELECT * FROM {name} WHERE COLUMNS(*) IS NOT NULL"


# Order features regressed on the review score by ``significant_coefs``, and
# on the price by ``significant_coefs_price``.
OLS_FEATURES = (
    "wait_time", "delay_vs_expected", "number_of_products", "number_of_sellers",
    "price", "freight_value",
)
BASKET_FEATURES = (
    "wait_time", "delay_vs_expected", "number_of_sellers", "price", "freight_value", "review_score",
)

# Reviews with the messages and times that ``roundtrip`` writes.
WORDED = """(SELECT review_id, order_id, review_score, CAST(NULL AS VARCHAR) AS review_comment_title,
    CASE review_id % 3 WHEN 0 THEN coalesce(review_comment_message, '') || chr(10) || '"' || review_id
      || '", he said,' || chr(13) || chr(10) || chr(10) || 'then ""nothing'
    WHEN 1 THEN review_comment_message END AS review_comment_message,
    TIMESTAMP '2018-01-01 00:00:00' + to_hours(CAST(review_id % 1000 AS INTEGER)) AS review_answer_timestamp
  FROM m_reviews)"""

QUERIES: dict[str, Query] = {
    # sources and link table
    "csv_reviews": Query(
        roundtrip.reviews_through_csv,
        f"""SELECT CAST(review_id AS VARCHAR) AS review_id, CAST(order_id AS VARCHAR) AS order_id,
  review_score, review_comment_title, review_comment_message, review_answer_timestamp FROM {WORDED}""",
    ),
    "csv_rejects": Query(
        roundtrip.rejected_reviews,
        f"""SELECT 'review_score' AS "column", 'value' AS reason, 'score ' || review_id AS raw FROM {WORDED} WHERE review_id % 50 = 3
UNION ALL
SELECT 'review_creation_date', 'value', 'day ' || review_id FROM {WORDED} WHERE review_id % 70 = 6
UNION ALL
SELECT NULL, 'number of fields', concat_ws(',', review_id, order_id,
    CASE WHEN review_id % 50 = 3 THEN 'score ' || review_id ELSE coalesce(CAST(review_score AS VARCHAR), '') END, '',
    CASE WHEN review_comment_message IS NULL THEN ''
      WHEN regexp_matches(review_comment_message, '[",\n\r]')
      THEN '"' || replace(review_comment_message, '"', '""') || '"' ELSE review_comment_message END,
    CASE WHEN review_id % 70 = 6 THEN 'day ' || review_id ELSE '' END,
    strftime(review_answer_timestamp, '%Y-%m-%d %H:%M:%S'), 'one more')
FROM {WORDED} WHERE review_id % 90 = 4""",
    ),
    "link_table": Query(link.link_table, _select("link")),
    "link_table_legacy": Query(
        lambda m: link.link_table(m, legacy_order=True),
        "SELECT order_id, seller_id, product_id, review_id, customer_id FROM link",
    ),
    # order mart
    "order_wait_time": Query(orders.wait_time, _select("b1"), WAIT),
    "order_wait_time_all_statuses": Query(
        lambda m: orders.wait_time(m, is_delivered=False), _select("b1_all"), WAIT
    ),
    "order_wait_time_legacy": Query(
        lambda m: orders.wait_time(m, legacy=True), _select("l1"), WAIT
    ),
    "order_review_flags": Query(orders.review_flags, _select("b2")),
    "order_item_count": Query(orders.number_of_products, _select("b3")),
    "order_item_count_legacy": Query(
        lambda m: orders.number_of_products(m, legacy=True), _select("l3")
    ),
    "order_seller_count": Query(orders.number_of_sellers, _select("b4")),
    "order_price_freight": Query(orders.price_and_freight, _select("b5"), ("price", "freight_value")),
    "order_seller_distance": Query(
        orders.seller_customer_distance, _select("b6"), ("distance_seller_customer",)
    ),
    "order_features": Query(orders.order_features, _not_null("b7"), ORDER_DOUBLES),
    "order_features_all_statuses": Query(
        lambda m: orders.order_features(m, is_delivered=False),
        """SELECT * FROM (
SELECT order_id, wait_time, expected_wait_time, delay_vs_expected, order_status,
  dim_is_five_star, dim_is_one_star, review_score, number_of_products, number_of_sellers,
  price, freight_value
FROM b1_all JOIN b2 USING (order_id) JOIN b3 USING (order_id) JOIN b4 USING (order_id)
  JOIN b5 USING (order_id)) WHERE COLUMNS(*) IS NOT NULL""",
        ORDER_DOUBLES,
    ),
    "order_features_legacy": Query(
        lambda m: orders.order_features(m, legacy=True),
        """SELECT * FROM (
SELECT order_id, wait_time, expected_wait_time, delay_vs_expected, order_status,
  dim_is_five_star, dim_is_one_star, review_score, number_of_products, number_of_sellers,
  price, freight_value
FROM l1 JOIN b2 USING (order_id) JOIN l3 USING (order_id) JOIN b4 USING (order_id)
  JOIN b5 USING (order_id)) WHERE COLUMNS(*) IS NOT NULL""",
        ORDER_DOUBLES,
    ),
    "order_features_distance": Query(
        lambda m: orders.order_features(m, with_distance=True),
        """SELECT * FROM (SELECT * FROM b7 JOIN b6 USING (order_id))
WHERE COLUMNS(*) IS NOT NULL""",
        ORDER_DOUBLES + ("distance_seller_customer",),
    ),
    # seller mart
    "seller_features": Query(sellers.seller_features, _select("c1"), ("geolocation_lat", "geolocation_lng")),
    "seller_delay_wait": Query(sellers.delay_wait, _select("c2"), ("delay_to_carrier", "wait_time")),
    "seller_active_dates": Query(sellers.active_dates, _select("c3"), ("active_months",)),
    "seller_review_scores": Query(sellers.review_scores, _select("c4"), REVIEW_MEANS),
    "seller_quantity": Query(sellers.quantity, _select("c5"), ("quantity_per_order",)),
    "seller_sales": Query(sellers.sales, _select("c6"), ("sales",)),
    "seller_revenues": Query(sellers.revenues, _select("c7"), ("revenues",)),
    "seller_costs": Query(sellers.costs, _select("c8"), ("costs",)),
    "seller_profits": Query(sellers.profits, _select("c9"), ("profits",)),
    "seller_mart": Query(sellers.seller_mart, _select("c10"), SELLER_MART_DOUBLES),
    "seller_mart_refreshed": Query(replay.refreshed_seller_mart, _select("c10"), SELLER_MART_DOUBLES),
    "seller_mart_legacy": Query(
        sellers.legacy_seller_mart,
        _not_null("l12"),
        ("delay_to_carrier", "wait_time", "share_of_five_stars", "share_of_one_stars",
         "review_score", "quantity_per_order", "sales"),
    ),
    "seller_features_legacy": Query(
        lambda m: sellers.seller_features(m, legacy=True),
        "SELECT seller_id, seller_city, seller_state FROM m_sellers",
    ),
    "seller_delay_wait_legacy": Query(
        lambda m: sellers.delay_wait(m, legacy=True), _select("l8"),
        ("delay_to_carrier", "wait_time"),
    ),
    "seller_active_dates_legacy": Query(
        lambda m: sellers.active_dates(m, legacy=True), _select("l9")
    ),
    "seller_review_scores_legacy": Query(
        sellers.legacy_review_scores, _select("l10"), REVIEW_MEANS
    ),
    "seller_quantity_legacy": Query(
        lambda m: sellers.quantity_sales(m, legacy=True).select(
            "seller_id", "n_orders", "quantity", "quantity_per_order"
        ),
        _select("l11"),
        ("quantity_per_order",),
    ),
    # product mart
    "product_features": Query(products.product_features, _select("d1")),
    "product_price": Query(products.price, _select("d2"), ("price",)),
    "product_wait_time": Query(products.wait_time, _select("d3"), ("wait_time",)),
    "product_review_scores": Query(products.review_scores, _select("d4"), REVIEW_MEANS),
    "product_revenues": Query(products.revenues, _select("d5"), ("revenues",)),
    "product_costs": Query(products.costs, _select("d6"), ("costs",)),
    "product_profits": Query(products.profits, _select("d7"), ("profits",)),
    "product_quantity": Query(products.quantity, _select("d8")),
    "product_sales": Query(products.sales, _select("d9"), ("sales",)),
    "product_mart": Query(products.product_mart, _select("d10"), PRODUCT_MART_DOUBLES),
    "product_mart_refreshed": Query(replay.refreshed_product_mart, _select("d10"), PRODUCT_MART_DOUBLES),
    "product_mart_with_freight": Query(
        lambda m: products.product_mart(m, with_freight=True),
        """SELECT d10.*, freight_value FROM d10 JOIN (
  SELECT product_id, CAST(sum(freight_value) AS DOUBLE) / count(freight_value) AS freight_value
  FROM m_items WHERE product_id IS NOT NULL GROUP BY product_id) USING (product_id)""",
        PRODUCT_MART_DOUBLES + ("freight_value",),
    ),
    # reviews
    "review_length": Query(reviews.review_length, _select("h1")),
    "review_main_category": Query(reviews.main_product_category, _select("h2")),
    "review_features": Query(reviews.review_features, _select("h3")),
    "review_score_quality": Query(
        reviews.bad_scores,
        """SELECT review_score, count(*) AS n_reviews FROM m_reviews
WHERE review_score IS NOT NULL AND review_score NOT BETWEEN 1 AND 5 GROUP BY review_score""",
    ),
    "review_category": Query(
        reviews.review_category,
        "SELECT review_id, order_id, product_category FROM m_reviews JOIN h2 USING (order_id)",
    ),
    "review_score_counts": Query(
        lambda m: reviews.score_counts(m, lowest=2),
        """SELECT review_score, count(*) AS n_reviews,
  coalesce(review_score BETWEEN 2 AND 5, false) AS is_valid
FROM m_reviews GROUP BY review_score""",
    ),
    # ranking, what-if and segments over the seller mart
    "seller_ranked": Query(
        lambda m: segments.seller_ranking(_ranked(m)),
        "SELECT seller_id, profits, sales_per_order, profit_rank FROM ranked",
        ("profits", "sales_per_order"),
    ),
    "removal_gain_curve": Query(
        lambda m: segments.removal_gain_curve(_ranked(m)),
        "SELECT n_sellers_removed, benefits_of_removing FROM curve",
        ("benefits_of_removing",),
    ),
    "removal_gain_points": Query(
        lambda m: segments.removal_gain_points(_ranked(m)),
        """SELECT 'worst' AS point, n_sellers_removed, benefits_of_removing FROM curve
  WHERE n_sellers_removed = k_worst
UNION ALL SELECT 'bad', n_sellers_removed, benefits_of_removing FROM curve
  WHERE n_sellers_removed = k_bad
UNION ALL SELECT 'neutral', n_sellers_removed, benefits_of_removing FROM curve
  WHERE n_sellers_removed = k_neutral
UNION ALL (SELECT 'best', n_sellers_removed, benefits_of_removing FROM curve
  WHERE benefits_of_removing IS NOT NULL
  ORDER BY benefits_of_removing DESC, n_sellers_removed LIMIT 1)""",
        ("benefits_of_removing",),
    ),
    "seller_segments": Query(
        lambda m: segments.seller_segments(_ranked(m)).select(
            "seller_id", "profits", "removal_rank", "profile"
        ),
        "SELECT seller_id, profits, removal_rank, profile FROM segments",
        ("profits",),
    ),
    "seller_cohorts": Query(
        lambda m: segments.seller_cohorts(_ranked(m)).select("seller_id", "cohort"),
        "SELECT seller_id, cohort FROM cohorts",
    ),
    "segment_sizes": Query(
        lambda m: segments.segment_sizes(_profiled(m)),
        "SELECT profile, count(*) AS n_sellers FROM segments GROUP BY profile",
    ),
    "behaviour_points": Query(
        lambda m: segments.behaviour_points(sellers.seller_mart(m)),
        """SELECT seller_id, share_of_one_stars, sales / n_orders AS sales_per_order, sales, profits,
  coalesce(share_of_one_stars BETWEEN 0.0 AND 0.3 AND sales / n_orders BETWEEN 0.0 AND 500.0,
           false) AS in_window
FROM c10""",
        ("share_of_one_stars", "sales_per_order", "sales", "profits"),
    ),
    "at_risk_sellers": Query(
        lambda m: segments.at_risk_sellers(sellers.seller_mart(m)),
        """SELECT seller_id, share_of_one_stars, wait_time, sales / n_orders AS sales_per_order, profits
FROM c10 WHERE share_of_one_stars > 0.10 AND wait_time > 12.0 AND sales / n_orders < 200.0""",
        ("share_of_one_stars", "wait_time", "sales_per_order", "profits"),
    ),
    # the same operators with values that split the driver tables' sellers
    "behaviour_points_narrow": Query(
        lambda m: segments.behaviour_points(sellers.seller_mart(m), 0.18, 380.0),
        """SELECT seller_id, share_of_one_stars, sales / n_orders AS sales_per_order, sales, profits,
  coalesce(share_of_one_stars BETWEEN 0.0 AND 0.18 AND sales / n_orders BETWEEN 0.0 AND 380.0,
           false) AS in_window
FROM c10""",
        ("share_of_one_stars", "sales_per_order", "sales", "profits"),
    ),
    "at_risk_sellers_wide": Query(
        lambda m: segments.at_risk_sellers(
            sellers.seller_mart(m), segments.RiskRule(0.18, 12.0, 380.0)
        ),
        """SELECT seller_id, share_of_one_stars, wait_time, sales / n_orders AS sales_per_order, profits
FROM c10 WHERE share_of_one_stars > 0.18 AND wait_time > 12.0 AND sales / n_orders < 380.0""",
        ("share_of_one_stars", "wait_time", "sales_per_order", "profits"),
    ),
    "city_rollup": Query(
        lambda m: segments.city_rollup(sellers.seller_mart(m)),
        _select("e14"),
        ("avg_delay_to_carrier", "avg_wait_time", "avg_active_months", "avg_review_score",
         "total_profits", "total_sales", "lat", "lng"),
    ),
    # distributions per segment
    "kde_active_months": Query(
        lambda m: analysis.kde_active_months(segments.seller_cohorts(_ranked(m))),
        *sql.kde_query("e8", "cohorts", "cohort", "active_months", 200, 3.0),
    ),
    "kde_wait_time": Query(
        lambda m: analysis.kde_wait_time(_profiled(m)),
        *sql.kde_query("e8w", "segments", "profile", "wait_time", 200, 3.0),
    ),
    "kde_wait_time_binned": Query(
        lambda m: analysis.kde_wait_time(_profiled(m), binned=True),
        *sql.kde_binned_query("e8b", "segments", "profile", "wait_time", 200, 3.0, 1e-4),
    ),
    "box_wait_time": Query(
        lambda m: analysis.box_wait_time(_profiled(m)),
        sql.box_sql("segments", "profile", "wait_time"),
        ("q1", "median", "q3", "whislo", "whishi"),
    ),
    "box_wait_time_fliers": Query(
        lambda m: analysis.fliers_wait_time(_profiled(m)),
        f"""SELECT profile, seller_id, wait_time FROM segments
JOIN ({sql.box_sql("segments", "profile", "wait_time")}) AS box USING (profile)
WHERE wait_time < whislo OR wait_time > whishi""",
        ("wait_time",),
    ),
    "violin_sales_per_order": Query(
        lambda m: analysis.violin_sales_per_order(_profiled(m)),
        *sql.violin_query("e10", "segments", "profile", "sales_per_order"),
    ),
    "mean_one_star": Query(
        lambda m: analysis.mean_one_star(_profiled(m)),
        """SELECT profile, avg(share_of_one_stars) AS mean_share_of_one_stars,
  count(share_of_one_stars) AS n_sellers FROM segments GROUP BY profile""",
        ("mean_share_of_one_stars",),
    ),
    "mean_one_star_ci": Query(
        lambda m: analysis.mean_one_star_ci(_profiled(m)),
        sql.bootstrap_sql("segments", "profile", "share_of_one_stars", "seller_id",
                          analysis.BOOT_REPLICATES, analysis.BOOT_LEVEL, 0),
        ("mean", "ci_low", "ci_high"),
    ),
    "kde_by_dimension": Query(
        lambda m: analysis.kde_by_dimension(orders.order_features(m), "wait_time", "review_score"),
        *sql.kde_query("e17", "b7", "review_score", "wait_time", 200, 3.0),
    ),
    "significant_coefs": Query(
        lambda m: analysis.significant_coefficients(
            analysis.ols(orders.order_features(m), "review_score", list(OLS_FEATURES))
        ),
        sql.ols_sql("b7", "review_score", OLS_FEATURES, analysis.P_VALUE),
        ("p_value", "coef"),
    ),
    # scores of the driver tables depend on nothing; basket sizes do
    "significant_coefs_basket": Query(
        lambda m: analysis.significant_coefficients(
            analysis.ols(orders.order_features(m), "number_of_products", list(BASKET_FEATURES))
        ),
        sql.ols_sql("b7", "number_of_products", BASKET_FEATURES, analysis.P_VALUE),
        ("p_value", "coef"),
    ),
    "significant_coefs_qr": Query(
        lambda m: analysis.significant_coefficients(
            analysis.ols_qr(orders.order_features(m), "number_of_products", list(BASKET_FEATURES))
        ),
        sql.ols_sql("b7", "number_of_products", BASKET_FEATURES, analysis.P_VALUE),
        ("p_value", "coef"),
    ),
    # drawn weights: no SQL; held against the full bootstrap in the tests
    "mean_wait_time_ci": Query(
        lambda m: analysis.mean_wait_time_ci(orders.order_features(m)),
        None,
        ("mean", "ci_low", "ci_high"),
    ),
}


def _profiled(m: Marketplace) -> DataFrame:
    return segments.profiled_sellers(sellers.seller_mart(m), segments.SCALED_CUTOFFS)


def _ranked(m: Marketplace) -> DataFrame:
    return segments.ranked_sellers(sellers.seller_mart(m), segments.SCALED_CUTOFFS)


_CATALOGS: dict[tuple[SparkSession, str], Marketplace] = {}


def marketplace(spark: SparkSession, sf_dir: str) -> Marketplace:
    """The lazy marketplace view of ``sf_dir``, built once per session.

    Only plans are kept (no data): repeated queries skip re-reading the
    parquet footers and re-analysing the source projections.
    """
    key = (spark, sf_dir)
    if any(known is not spark for known, _ in _CATALOGS):
        _CATALOGS.clear()  # plans of a session that has ended
    if key not in _CATALOGS:
        _CATALOGS[key] = load_star_marketplace(spark, sf_dir)
    return _CATALOGS[key]


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    q = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return canonical(q.run(marketplace(spark, sf_dir)))

    run.__name__ = name
    return run


def oracle_sql(name: str) -> str | None:
    q = QUERIES[name]
    if q.oracle is None:
        return None
    return sql.canonical_sql(sql.with_model(q.oracle), q.doubles)
