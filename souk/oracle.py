"""DuckDB reference SQL for the registered queries.

Each query is written in its naive form, the way the semantics read: the
link table is materialised, means run over its fan-out rows, the marts are
inner joins of separate per-entity tables. The Spark operators use
rewritten plans (fused aggregates, per-order review statistics, semi
joins); agreement on the driver tables checks the rewrites as well.

``MODEL`` maps the driver's star-schema tables onto the marketplace model
with the same expressions as ``souk.sources.star``. Double columns are
canonicalised the same way on both sides (``canonical_sql`` here,
``souk.functions.canonical.canonical`` in Spark).
"""

from __future__ import annotations

from souk.plans.distributions import poisson1_thresholds


def days(a: str, b: str) -> str:
    return f"(date_diff('microsecond', {a}, {b}) / 86400000000.0)"


def micros(a: str, b: str) -> str:
    return f"date_diff('microsecond', {a}, {b})"


def mean_days(x: str) -> str:
    """Mean of a microsecond duration in days, evaluated exactly: integer
    sum, one division (a mean of per-row doubles depends on the order)."""
    return f"(CAST(sum({x}) AS DOUBLE) / (count({x}) * 86400000000.0))"


def late_micros(a: str, b: str) -> str:
    d = micros(a, b)
    return f"(CASE WHEN {d} > 0 THEN {d} ELSE 0 END)"


def late(a: str, b: str) -> str:
    d = days(a, b)
    return f"(CASE WHEN {d} > 0 THEN {d} ELSE 0.0 END)"


def flag(col: str, value: int) -> str:
    return f"CAST(coalesce({col} = {value}, false) AS INTEGER)"


def review_cost(col: str, base: float, mid: float) -> str:
    return (
        f"(CASE WHEN {col} IN (1, 2) THEN CAST({base} AS DOUBLE) / {col} "
        f"WHEN {col} = 3 THEN CAST({mid} AS DOUBLE) ELSE 0.0 END)"
    )


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    la1, la2, lo1, lo2 = (f"radians({c})" for c in (lat1, lat2, lon1, lon2))
    s_lat = f"sin(({la2} - {la1}) / 2)"
    s_lon = f"sin(({lo2} - {lo1}) / 2)"
    a = f"{s_lat} * {s_lat} + cos({la1}) * cos({la2}) * {s_lon} * {s_lon}"
    return f"(2 * 6371 * asin(sqrt(least({a}, 1.0))))"


def half_even(x: str, digits: int) -> str:
    scale = float(10**digits)
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


def active_months(first: str, last: str) -> str:
    return (
        f"CAST(floor(date_diff('microsecond', {first}, {last}) / 2629746000000.0 + 1)"
        " AS DOUBLE)"
    )


MODEL_CTES = {
    "m_orders": f"""
SELECT o_orderkey AS order_id, o_custkey AS customer_id,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN 'delivered' ELSE 'shipped' END AS order_status,
  o_orderdate AS order_purchase_timestamp,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL
       ELSE o_orderdate + CAST(o_orderkey % 48 AS BIGINT) * INTERVAL '1 hour' END AS order_approved_at,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL
       ELSE o_orderdate + CAST(1 + o_orderkey % 6 AS BIGINT) * INTERVAL '1 day' END AS order_delivered_carrier_date,
  CASE WHEN o_orderkey % 89 = 0 OR (o_orderstatus = 'P' AND o_orderkey % 11 <> 0) THEN NULL
       ELSE o_orderdate + CAST(72 + (o_orderkey * 7) % 700 AS BIGINT) * INTERVAL '1 hour' END
       AS order_delivered_customer_date,
  o_orderdate + CAST(10 + (o_orderkey * 13) % 20 AS BIGINT) * INTERVAL '1 day' AS order_estimated_delivery_date
FROM orders""",
    "m_items": """
SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
  l_suppkey AS seller_id,
  o.o_orderdate + CAST(1 + l_linenumber % 5 AS BIGINT) * INTERVAL '1 day' AS shipping_limit_date,
  CAST(CAST(floor(l_extendedprice) AS BIGINT) * CAST(0.007 AS DECIMAL(4, 3)) AS DECIMAL(18, 3)) AS price,
  CAST(CAST(round(l_tax * 100) AS INTEGER) AS DECIMAL(18, 3)) AS freight_value
FROM lineitem LEFT JOIN orders o ON l_orderkey = o.o_orderkey""",
    "m_reviews": """
SELECT o_orderkey * 2 + k AS review_id, o_orderkey AS order_id,
  CASE WHEN k = 0 THEN TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER)
       ELSE CAST(1 + o_orderkey % 5 AS INTEGER) END AS review_score,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS review_comment_message
FROM orders, (VALUES (0), (1)) AS ks(k)
WHERE o_orderkey % 10 <> 0 AND (k = 0 OR o_orderkey % 10 = 1)""",
    "m_places": """
SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
    "m_geo": """
SELECT n_nationkey AS geolocation_zip_code_prefix,
  CAST(-30 + n_nationkey + k * 0.25 AS DOUBLE) AS geolocation_lat,
  CAST(-60 + (n_nationkey * 7) % 25 + k * 0.25 AS DOUBLE) AS geolocation_lng,
  n_name AS geolocation_city, r_name AS geolocation_state, CAST(n_nationkey * 3 + k AS BIGINT) AS seq
FROM m_places, (VALUES (0), (1), (2)) AS ks(k) WHERE n_nationkey <> 13""",
    "m_sellers": """
SELECT s_suppkey AS seller_id, s_nationkey AS seller_zip_code_prefix, n_name AS seller_city,
  r_name AS seller_state
FROM supplier LEFT JOIN m_places ON s_nationkey = n_nationkey""",
    "m_customers": """
SELECT c_custkey AS customer_id, c_nationkey AS customer_zip_code_prefix, n_name AS customer_city,
  r_name AS customer_state
FROM customer LEFT JOIN m_places ON c_nationkey = n_nationkey""",
    "m_products": """
SELECT p_partkey AS product_id,
  CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE p_type END AS product_category_name,
  CAST(length(p_name) AS INTEGER) AS product_name_lenght,
  CAST(length(p_type) AS INTEGER) AS product_description_lenght,
  p_size % 6 AS product_photos_qty, p_size * 100 AS product_weight_g,
  p_size + 10 AS product_length_cm, p_size % 7 + 2 AS product_height_cm,
  p_size % 9 + 5 AS product_width_cm
FROM part""",
    "m_translation": """
SELECT DISTINCT p_type AS product_category_name, lower(p_type) AS product_category_name_english
FROM part WHERE p_type <> 'PROMO'""",
}

# Naive forms of the operators, as CTEs over the model.
OPERATOR_CTES = {
    "link": """
SELECT customer_id, order_id, review_id, product_id, seller_id
FROM (SELECT order_id, customer_id FROM m_orders) o
FULL OUTER JOIN (SELECT order_id, review_id FROM m_reviews) r USING (order_id)
FULL OUTER JOIN (SELECT order_id, product_id, seller_id FROM m_items) i USING (order_id)""",
    "b1": f"""
SELECT order_id,
  {days('order_purchase_timestamp', 'order_delivered_customer_date')} AS wait_time,
  {days('order_purchase_timestamp', 'order_estimated_delivery_date')} AS expected_wait_time,
  {late('order_estimated_delivery_date', 'order_delivered_customer_date')} AS delay_vs_expected,
  order_status
FROM m_orders WHERE order_status = 'delivered'""",
    "b1_all": f"""
SELECT order_id,
  {days('order_purchase_timestamp', 'order_delivered_customer_date')} AS wait_time,
  {days('order_purchase_timestamp', 'order_estimated_delivery_date')} AS expected_wait_time,
  {late('order_estimated_delivery_date', 'order_delivered_customer_date')} AS delay_vs_expected,
  order_status
FROM m_orders""",
    "b2": f"""
SELECT order_id, {flag('review_score', 5)} AS dim_is_five_star,
  {flag('review_score', 1)} AS dim_is_one_star, review_score
FROM m_reviews""",
    "b3": """
SELECT order_id, count(order_item_id) AS number_of_products FROM m_items
WHERE order_id IS NOT NULL GROUP BY order_id""",
    "b4": """
SELECT order_id, count(DISTINCT seller_id) AS number_of_sellers FROM m_items
WHERE order_id IS NOT NULL GROUP BY order_id""",
    "b5": """
SELECT order_id, CAST(coalesce(sum(price), 0) AS DOUBLE) AS price,
  CAST(coalesce(sum(freight_value), 0) AS DOUBLE) AS freight_value
FROM m_items WHERE order_id IS NOT NULL GROUP BY order_id""",
    "geo_zip": """
SELECT geolocation_zip_code_prefix AS zip,
  arg_min(geolocation_lat, seq) FILTER (WHERE geolocation_lat IS NOT NULL) AS lat,
  arg_min(geolocation_lng, seq) FILTER (WHERE geolocation_lng IS NOT NULL) AS lng
FROM m_geo WHERE geolocation_zip_code_prefix IS NOT NULL GROUP BY 1""",
    "geo_city": """
SELECT geolocation_city AS city,
  arg_min(geolocation_lat, seq) FILTER (WHERE geolocation_lat IS NOT NULL) AS lat,
  arg_min(geolocation_lng, seq) FILTER (WHERE geolocation_lng IS NOT NULL) AS lng
FROM m_geo WHERE geolocation_city IS NOT NULL GROUP BY 1""",
    "b6_rows": """
SELECT l.*, s.seller_zip_code_prefix, s.seller_city, s.seller_state, gs.lat AS lat_s, gs.lng AS lng_s,
  c.customer_zip_code_prefix, c.customer_city, c.customer_state, gc.lat AS lat_c, gc.lng AS lng_c
FROM link l
JOIN (m_sellers s LEFT JOIN geo_zip gs ON s.seller_zip_code_prefix = gs.zip) ON l.seller_id = s.seller_id
JOIN (m_customers c LEFT JOIN geo_zip gc ON c.customer_zip_code_prefix = gc.zip)
  ON l.customer_id = c.customer_id""",
    "b6": f"""
SELECT order_id, avg({haversine('lng_s', 'lat_s', 'lng_c', 'lat_c')}) AS distance_seller_customer
FROM b6_rows
WHERE COLUMNS(*) IS NOT NULL
GROUP BY order_id""",
    "b7": """
SELECT order_id, wait_time, expected_wait_time, delay_vs_expected, order_status,
  dim_is_five_star, dim_is_one_star, review_score, number_of_products, number_of_sellers,
  price, freight_value
FROM b1 JOIN b2 USING (order_id) JOIN b3 USING (order_id) JOIN b4 USING (order_id)
  JOIN b5 USING (order_id)""",
    # sellers
    "c1": """
SELECT s.seller_id, s.seller_city, s.seller_state, g.lat AS geolocation_lat,
  g.lng AS geolocation_lng
FROM (SELECT DISTINCT * FROM m_sellers) s LEFT JOIN geo_city g ON s.seller_city = g.city""",
    "c2": f"""
SELECT seller_id,
  {mean_days(late_micros('i.shipping_limit_date', 'o.order_delivered_carrier_date'))} AS delay_to_carrier,
  {mean_days(micros('o.order_purchase_timestamp', 'o.order_delivered_customer_date'))} AS wait_time
FROM m_items i JOIN m_orders o USING (order_id)
WHERE o.order_status = 'delivered' AND seller_id IS NOT NULL
GROUP BY seller_id""",
    "c3": f"""
SELECT seller_id, min(order_approved_at) AS date_first_sale, max(order_approved_at) AS date_last_sale,
  {active_months('min(order_approved_at)', 'max(order_approved_at)')} AS active_months
FROM link JOIN m_orders USING (order_id)
WHERE seller_id IS NOT NULL GROUP BY seller_id""",
    "pairs_s": "SELECT DISTINCT order_id, seller_id FROM link",
    "c4": """
SELECT seller_id, avg(dim_is_one_star) AS share_of_one_stars,
  avg(dim_is_five_star) AS share_of_five_stars, avg(review_score) AS review_score
FROM pairs_s JOIN b2 USING (order_id)
WHERE seller_id IS NOT NULL GROUP BY seller_id""",
    "c5": """
SELECT seller_id, count(DISTINCT order_id) AS n_orders, count(order_id) AS quantity,
  count(order_id) / count(DISTINCT order_id) AS quantity_per_order
FROM m_items WHERE seller_id IS NOT NULL GROUP BY seller_id""",
    "c6_dec": """
SELECT seller_id, coalesce(sum(price), 0) AS sales_dec
FROM m_items WHERE seller_id IS NOT NULL GROUP BY seller_id""",
    "c6": "SELECT seller_id, CAST(sales_dec AS DOUBLE) AS sales FROM c6_dec",
    "c7": """
SELECT seller_id, CAST(sales_dec * CAST(0.10 AS DECIMAL(3, 2)) AS DOUBLE)
  + CAST(80.0 AS DOUBLE) * active_months AS revenues
FROM c6_dec LEFT JOIN c3 USING (seller_id)""",
    "c8_review": f"""
SELECT seller_id, sum({review_cost('review_score', 100.0, 40.0)}) AS review_costs
FROM pairs_s JOIN m_reviews USING (order_id)
WHERE seller_id IS NOT NULL GROUP BY seller_id""",
    "c8_it": """
SELECT seller_id,
  sqrt(n_orders) * (CAST(500000.0 AS DOUBLE) / (SELECT sum(sqrt(n_orders)) FROM c5)) AS it_costs
FROM c5""",
    "c8": """
SELECT seller_id, it_costs + review_costs AS costs FROM c8_review JOIN c8_it USING (seller_id)""",
    "c9": "SELECT seller_id, revenues - costs AS profits FROM c7 JOIN c8 USING (seller_id)",
    "c10": """
SELECT seller_id, seller_city, seller_state, geolocation_lat, geolocation_lng,
  delay_to_carrier, wait_time, date_first_sale, date_last_sale, active_months,
  share_of_one_stars, share_of_five_stars, review_score, costs, revenues, profits,
  n_orders, quantity, quantity_per_order, sales
FROM c1 JOIN c2 USING (seller_id) JOIN c3 USING (seller_id) JOIN c4 USING (seller_id)
  JOIN c8 USING (seller_id) JOIN c7 USING (seller_id) JOIN c9 USING (seller_id)
  JOIN c5 USING (seller_id) JOIN c6 USING (seller_id)""",
    # products
    "d1": """
SELECT product_id, product_name_lenght AS product_name_length,
  product_description_lenght AS product_description_length, product_photos_qty,
  product_weight_g, product_length_cm, product_height_cm, product_width_cm,
  product_category_name_english AS category
FROM m_products JOIN m_translation USING (product_category_name)""",
    "d2": """
SELECT product_id, CAST(sum(price) AS DOUBLE) / count(price) AS price
FROM m_items WHERE product_id IS NOT NULL GROUP BY product_id""",
    "d3": f"""
SELECT product_id, {mean_days('wait_us')} AS wait_time
FROM link JOIN (SELECT order_id,
    {micros('order_purchase_timestamp', 'order_delivered_customer_date')} AS wait_us
  FROM m_orders WHERE order_status = 'delivered') USING (order_id)
WHERE product_id IS NOT NULL GROUP BY product_id""",
    "pairs_p": "SELECT DISTINCT order_id, product_id FROM link",
    "d4": """
SELECT product_id, avg(dim_is_one_star) AS share_of_one_stars,
  avg(dim_is_five_star) AS share_of_five_stars, avg(review_score) AS review_score
FROM pairs_p JOIN b2 USING (order_id)
WHERE product_id IS NOT NULL GROUP BY product_id""",
    "d9_dec": """
SELECT product_id, coalesce(sum(price), 0) AS sales_dec
FROM m_items WHERE product_id IS NOT NULL GROUP BY product_id""",
    "d5": """
SELECT product_id, CAST(sales_dec * CAST(0.10 AS DECIMAL(3, 2)) AS DOUBLE) AS revenues FROM d9_dec""",
    "d6": f"""
SELECT product_id, sum({review_cost('review_score', 75.0, 30.0)}) AS costs
FROM pairs_p JOIN m_reviews USING (order_id)
WHERE product_id IS NOT NULL GROUP BY product_id""",
    "d7": "SELECT product_id, revenues - costs AS profits FROM d5 JOIN d6 USING (product_id)",
    "d8": """
SELECT product_id, count(DISTINCT order_id) AS n_orders, count(order_id) AS quantity
FROM m_items WHERE product_id IS NOT NULL GROUP BY product_id""",
    "d9": "SELECT product_id, CAST(sales_dec AS DOUBLE) AS sales FROM d9_dec",
    "d10": """
SELECT product_id, product_name_length, product_description_length, product_photos_qty,
  product_weight_g, product_length_cm, product_height_cm, product_width_cm, category,
  wait_time, price, share_of_one_stars, share_of_five_stars, review_score, costs,
  revenues, profits, n_orders, quantity, sales
FROM d1 JOIN d3 USING (product_id) JOIN d2 USING (product_id) JOIN d4 USING (product_id)
  JOIN d6 USING (product_id) JOIN d5 USING (product_id) JOIN d7 USING (product_id)
  JOIN d8 USING (product_id) JOIN d9 USING (product_id)""",
}


def with_model(select: str, extra_ctes: dict[str, str] | None = None) -> str:
    """``select`` preceded by every model and operator CTE (DuckDB skips the
    ones it does not reference)."""
    ctes = {**MODEL_CTES, **OPERATOR_CTES, **(extra_ctes or {})}
    body = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in ctes.items())
    return f"WITH {body}\n{select.strip()}"


def canonical_sql(sql: str, doubles: tuple[str, ...]) -> str:
    """Round the ``doubles`` columns the way ``canonical`` does in Spark:
    rint(x * 1e6) / 1e6, with -0.0 folded to 0.0."""
    if not doubles:
        return sql
    parts = []
    for c in doubles:
        r = f"round_even({c} * 1000000.0, 0) / 1000000.0"
        parts.append(f"CASE WHEN {r} = 0 THEN 0.0 ELSE {r} END AS {c}")
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM (\n{sql}\n) AS q"


# Ranking and segments over the naive seller mart (c10).
REMOVAL_WINDOW = (
    "ORDER BY profits ASC NULLS FIRST, seller_id DESC NULLS LAST, "
    "seller_city DESC NULLS LAST, seller_state DESC NULLS LAST"
)


def _cutoff(c: int, of: int = 2970) -> str:
    return f"CAST(floor({c} * n_sellers / CAST({of} AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)"


SEGMENT_CTES = {
    "ranked0": f"""
SELECT *, sales / n_orders AS sales_per_order,
  ROW_NUMBER() OVER ({REMOVAL_WINDOW}) AS removal_rank,
  coalesce(SUM(coalesce(profits, 0)) OVER ({REMOVAL_WINDOW}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS removed_before,
  COUNT(*) OVER () AS n_sellers, SUM(profits) OVER () AS total_profits
FROM c10""",
    "ranked": f"""
SELECT *, n_sellers + 1 - removal_rank AS profit_rank,
  {_cutoff(180)} AS k_worst, {_cutoff(500)} AS k_bad, {_cutoff(1300)} AS k_neutral
FROM ranked0""",
    "curve": """
SELECT removal_rank - 1 AS n_sellers_removed,
  (-removed_before / total_profits) * 100 AS benefits_of_removing, k_worst, k_bad, k_neutral
FROM ranked""",
    "segments": """
SELECT *, CASE WHEN removal_rank <= k_worst THEN 'Worst' WHEN removal_rank <= k_bad THEN 'Bad'
  WHEN removal_rank <= k_neutral THEN 'Neutral' ELSE 'Good' END AS profile
FROM ranked""",
    "cohorts": """
SELECT *, 'worst' AS cohort FROM ranked WHERE removal_rank <= k_worst
UNION ALL SELECT *, 'bad' FROM ranked WHERE removal_rank <= k_bad
UNION ALL SELECT *, 'neutral' FROM ranked WHERE removal_rank <= k_neutral
UNION ALL SELECT *, 'good' FROM ranked WHERE removal_rank > k_neutral""",
}
OPERATOR_CTES.update(SEGMENT_CTES)


def kde_sql(prefix: str, src: str, group: str, value: str, gridsize: int, cut: float) -> tuple[dict[str, str], str]:
    """CTEs and final SELECT of a grid Gaussian KDE of ``value`` per ``group``."""
    g1 = gridsize - 1
    ctes = {
        f"{prefix}_v": f"SELECT {group} AS g, {value} AS v FROM {src} "
                       f"WHERE {value} IS NOT NULL AND {group} IS NOT NULL",
        f"{prefix}_s": f"""
SELECT g, n, bw, lo - {cut} * bw AS start, hi + {cut} * bw AS stop
FROM (SELECT g, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS bw, min(v) AS lo,
        max(v) AS hi FROM {prefix}_v GROUP BY g)
WHERE bw > 0""",
        f"{prefix}_g": f"""
SELECT g, n, bw, CAST(j AS INTEGER) AS point,
  CASE WHEN j = {g1} THEN stop ELSE j * ((stop - start) / {g1}) + start END AS x
FROM {prefix}_s, range(0, {gridsize}) AS t(j)""",
        f"{prefix}_c": f"SELECT g, v, count(*) AS c FROM {prefix}_v GROUP BY g, v",
    }
    select = f"""
SELECT g AS {group}, point, x,
  sum(c * exp(-0.5 * ((x - v) / bw) * ((x - v) / bw))) / (n * bw * sqrt(2 * pi())) AS density
FROM {prefix}_g JOIN {prefix}_c USING (g) GROUP BY g, point, x, n, bw"""
    return ctes, select


def quartiles_sql(src: str, group: str, value: str) -> str:
    return f"""
SELECT {group}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
  quantile_cont({value}, 0.75) AS q3
FROM {src} WHERE {value} IS NOT NULL AND {group} IS NOT NULL GROUP BY {group}"""


def box_sql(src: str, group: str, value: str, whis: float = 1.5) -> str:
    return f"""
SELECT {group}, n, q1, median, q3,
  CASE WHEN wlo IS NULL OR wlo > q1 THEN q1 ELSE wlo END AS whislo,
  CASE WHEN whi IS NULL OR whi < q3 THEN q3 ELSE whi END AS whishi, n_fliers
FROM (
  SELECT d.{group}, q1, median, q3, count(d.{value}) AS n,
    min(CASE WHEN d.{value} >= q1 - {whis} * (q3 - q1) THEN d.{value} END) AS wlo,
    max(CASE WHEN d.{value} <= q3 + {whis} * (q3 - q1) THEN d.{value} END) AS whi,
    count(*) FILTER (WHERE d.{value} < q1 - {whis} * (q3 - q1)
                     OR d.{value} > q3 + {whis} * (q3 - q1)) AS n_fliers
  FROM {src} d JOIN ({quartiles_sql(src, group, value)}) q USING ({group})
  WHERE d.{value} IS NOT NULL
  GROUP BY d.{group}, q1, median, q3)"""


def kde_binned_query(prefix: str, src: str, group: str, value: str, gridsize: int, cut: float, tolerance: float):
    """As ``kde_query``, over values shared out between the nodes of a fine grid."""
    ctes, select = kde_sql(prefix, src, group, value, gridsize, cut)
    ctes[f"{prefix}_c"] = f"""
SELECT g, start + j * delta AS v, sum(w) AS c
FROM (
  SELECT g, start, delta, floor(pos) + k AS j, CASE k WHEN 0 THEN 1 - (pos - floor(pos)) ELSE pos - floor(pos) END AS w
  FROM (
    SELECT g, start, delta, (v - start) / delta AS pos
    FROM {prefix}_v JOIN (
      SELECT g, start, sqrt(CAST(8.0 AS DOUBLE) * sqrt(2 * pi()) * CAST({tolerance} AS DOUBLE) * bw * bw * bw
        / (stop - start)) AS delta
      FROM {prefix}_s) USING (g)),
    range(0, 2) AS t(k))
GROUP BY g, start, delta, j"""
    OPERATOR_CTES.update(ctes)
    return select, ("x", "density")


def kde_query(prefix: str, src: str, group: str, value: str, gridsize: int, cut: float):
    """(oracle SQL, double columns) of a KDE query, for a registry entry."""
    ctes, select = kde_sql(prefix, src, group, value, gridsize, cut)
    OPERATOR_CTES.update(ctes)
    return select, ("x", "density")


def violin_query(prefix: str, src: str, group: str, value: str):
    ctes, select = kde_sql(prefix, src, group, value, 100, 2.0)
    ctes[f"{prefix}_k"] = select + f"""
UNION ALL
SELECT {group}, CAST(0 AS INTEGER) AS point, min({value}) AS x, 1.0 AS density FROM {src}
WHERE {value} IS NOT NULL AND {group} IS NOT NULL GROUP BY {group}
HAVING min({value}) = max({value})"""
    ctes[f"{prefix}_q"] = quartiles_sql(src, group, value)
    OPERATOR_CTES.update(ctes)
    return (
        f"SELECT * FROM {prefix}_k LEFT JOIN {prefix}_q USING ({group})",
        ("x", "density", "q1", "median", "q3"),
    )


def _he(x: str, digits: int) -> str:
    return half_even(x, digits)


OPERATOR_CTES.update({
    "l1": f"""
SELECT order_id, wait_time, expected_wait_time,
  CASE WHEN d < 0 THEN 0.0 ELSE d END AS delay_vs_expected, order_status
FROM (SELECT order_id, order_status,
        {days('order_purchase_timestamp', 'order_delivered_customer_date')} AS wait_time,
        {days('order_purchase_timestamp', 'order_estimated_delivery_date')} AS expected_wait_time,
        {days('order_estimated_delivery_date', 'order_delivered_customer_date')} AS d
      FROM m_orders WHERE order_status = 'delivered')""",
    "l3": """
SELECT order_id, max(order_item_id) AS number_of_products FROM m_items
WHERE order_id IS NOT NULL GROUP BY order_id""",
    "l8": f"""
SELECT seller_id,
  {mean_days(late_micros('i.shipping_limit_date', 'o.order_delivered_carrier_date'))} AS delay_to_carrier,
  {mean_days(micros('o.order_purchase_timestamp', 'o.order_delivered_customer_date'))} AS wait_time
FROM m_items i JOIN m_orders o USING (order_id)
WHERE seller_id IS NOT NULL GROUP BY seller_id""",
    "l9": """
SELECT seller_id, min(order_purchase_timestamp) AS date_first_sale,
  max(order_purchase_timestamp) AS date_last_sale
FROM m_items JOIN m_orders USING (order_id) WHERE seller_id IS NOT NULL GROUP BY seller_id""",
    "l10": """
SELECT seller_id, avg(dim_is_five_star) AS share_of_five_stars,
  avg(dim_is_one_star) AS share_of_one_stars, avg(review_score) AS review_score
FROM (SELECT * FROM b7 WHERE COLUMNS(*) IS NOT NULL) JOIN m_items USING (order_id)
WHERE seller_id IS NOT NULL GROUP BY seller_id""",
    "l11": """
SELECT seller_id, count(DISTINCT order_id) AS n_orders, count(product_id) AS quantity,
  count(product_id) / count(DISTINCT order_id) AS quantity_per_order
FROM m_items WHERE seller_id IS NOT NULL GROUP BY seller_id""",
    "l12": """
SELECT seller_id, seller_city, seller_state, delay_to_carrier, wait_time, date_first_sale,
  date_last_sale, share_of_five_stars, share_of_one_stars, review_score, n_orders, quantity,
  quantity_per_order, sales
FROM m_sellers JOIN l8 USING (seller_id) JOIN l9 USING (seller_id) JOIN l10 USING (seller_id)
  JOIN l11 USING (seller_id) JOIN c6 USING (seller_id)""",
    "h1": """
SELECT review_id, CAST(length(coalesce(review_comment_message, '')) AS INTEGER) AS length_review,
  review_score FROM m_reviews""",
    "h2": """
SELECT order_id, product_category_name AS product_category FROM (
  SELECT order_id, product_category_name, ROW_NUMBER() OVER (PARTITION BY order_id
    ORDER BY n_items DESC, price_sum DESC, product_category_name) AS rn
  FROM (SELECT order_id, product_category_name, count(*) AS n_items,
          coalesce(sum(price), 0) AS price_sum
        FROM m_items JOIN m_products USING (product_id)
        WHERE product_category_name IS NOT NULL
        GROUP BY order_id, product_category_name))
WHERE rn = 1""",
    "h3": """
SELECT review_id, order_id,
  CAST(length(coalesce(review_comment_message, '')) AS INTEGER) AS review_comment_length,
  product_category
FROM m_reviews LEFT JOIN h2 USING (order_id)""",
    "e14": f"""
SELECT DISTINCT * FROM (
  SELECT seller_city, avg_delay_to_carrier, avg_wait_time, avg_active_months, avg_review_score,
    total_profits, total_sales, n_sellers, lat, lng
  FROM (SELECT seller_city,
          {_he(_he('avg(delay_to_carrier)', 1), 0)} AS avg_delay_to_carrier,
          {_he(_he('avg(wait_time)', 1), 0)} AS avg_wait_time,
          {_he(_he('avg(active_months)', 1), 0)} AS avg_active_months,
          {_he(_he('avg(review_score)', 1), 0)} AS avg_review_score,
          {_he('coalesce(sum(profits), 0.0)', 0)} AS total_profits,
          {_he('coalesce(sum(sales), 0.0)', 0)} AS total_sales,
          count(seller_id) AS n_sellers
        FROM c10 WHERE seller_city IS NOT NULL GROUP BY seller_city)
  JOIN (SELECT DISTINCT seller_city, {_he('geolocation_lat', 2)} AS lat,
          {_he('geolocation_lng', 2)} AS lng
        FROM c10 WHERE seller_city IS NOT NULL) USING (seller_city))
WHERE COLUMNS(*) IS NOT NULL""",
})


def bootstrap_sql(src: str, group: str, value: str, row_id: str, replicates: int, level: float, seed: int) -> str:
    """Mean per group with a Poisson bootstrap interval, one row per
    (row, replicate)."""
    weight = " + ".join(f"CAST(u >= {t} AS INTEGER)" for t in poisson1_thresholds())
    lo, hi = (1 - level) / 2, (1 + level) / 2
    return f"""SELECT g.*, ci_low, ci_high FROM (
  SELECT {group}, avg({value}) AS mean, count({value}) AS n FROM {src}
  WHERE {value} IS NOT NULL GROUP BY {group}) AS g
LEFT JOIN (
  SELECT {group}, quantile_cont(m, {lo!r}) AS ci_low, quantile_cont(m, {hi!r}) AS ci_high FROM (
    SELECT {group}, b, sum(w * {value}) / nullif(sum(w), 0) AS m FROM (
      SELECT {group}, {value}, b, {weight} AS w FROM (
        SELECT {group}, {value}, b, CAST('0x' || substr(
          md5(concat_ws(':', {row_id}, b // 4, {seed})), CAST(b % 4 * 8 + 1 AS BIGINT), 8) AS BIGINT) AS u
        FROM {src}, range({replicates}) AS r(b) WHERE {value} IS NOT NULL))
    GROUP BY {group}, b)
  GROUP BY {group}) AS ci USING ({group})"""


def ols_sql(src: str, label: str, features: tuple[str, ...], alpha: float) -> str:
    """Significant coefficients of least squares: the sums of products of all
    columns, swept on the constant and on every feature."""
    columns = ["1", *features, label]
    size = len(columns)
    k = size - 1
    values = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(columns))
    given = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    sums = ", ".join(f"sum(x{i} * x{j})" for i in range(size) for j in range(size))
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(["Intercept", *features]))
    pivot = f"m[k * {size} + k + 1]"

    def area(lo: str) -> str:
        return (
            f"greatest(b - {lo}, 0) * list_sum([exp((nu - 1) * ln(cos({lo} + (x + 0.5) "
            f"* greatest(b - {lo}, 0) / 20000))) FOR x IN range(20000)])"
        )

    return f"""SELECT variable, p_value, coef FROM (
  WITH RECURSIVE sweep(k, n, m) AS (
    SELECT 0, count(*), [{sums}] FROM (SELECT {values} FROM {src} WHERE {given})
    UNION ALL
    SELECT k + 1, n, [CASE
      WHEN x // {size} = k AND x % {size} = k THEN 1 / {pivot}
      WHEN x // {size} = k THEN m[x + 1] / {pivot}
      WHEN x % {size} = k THEN -m[x + 1] / {pivot}
      ELSE m[x + 1] - m[x // {size} * {size} + k + 1] * m[k * {size} + x % {size} + 1] / {pivot}
      END FOR x IN range({size * size})]
    FROM sweep WHERE k < {k}
  ), fitted AS (
    SELECT variable, m[i * {size} + {k} + 1] AS coef, CAST(n - {k} AS DOUBLE) AS nu,
      sqrt(m[{size * size}] / (n - {k}) * m[i * {size} + i + 1]) AS se
    FROM sweep, (VALUES {names}) AS v(i, variable) WHERE k = {k}
  ), angles AS (
    SELECT *, atan(abs(coef / se) / sqrt(nu)) AS a, least(pi() / 2, 40 / sqrt(nu)) AS b FROM fitted
  )
  SELECT variable, coef, {area("a")} / ({area("0.0")}) AS p_value FROM angles)
WHERE p_value < {alpha!r}"""
