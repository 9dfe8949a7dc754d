"""Hand fixtures F1-F9 (FIXTURES.md part 3): literal rows, literal answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import market, money, rows, ts
from souk.functions.expr import round_half_even
from souk.operators import link, orders, products, reviews, segments, sellers
from souk.operators.economics import Rates
from souk.operators.geo import first_point
from souk.sources import schemas

APPROX = dict(rel=1e-12, abs=1e-12)


# F1 lateness clamp ---------------------------------------------------------

@pytest.fixture(scope="module")
def f1(spark):
    base = dict(
        order_purchase_timestamp=ts("2017-10-01 00:00:00"),
        order_estimated_delivery_date=ts("2017-10-15 00:00:00"),
    )
    return market(
        spark,
        orders=[
            dict(order_id="o1", order_status="delivered",
                 order_delivered_customer_date=ts("2017-10-11 12:00:00"), **base),
            dict(order_id="o2", order_status="delivered",
                 order_delivered_customer_date=ts("2017-10-18 06:00:00"), **base),
            dict(order_id="o3", order_status="delivered",
                 order_delivered_customer_date=None, **base),
            dict(order_id="o4", order_status="canceled",
                 order_delivered_customer_date=ts("2017-10-02 00:00:00"), **base),
        ],
    )


def test_f1_current_rule(f1):
    got = {r["order_id"]: r for r in rows(orders.wait_time(f1))}
    assert set(got) == {"o1", "o2", "o3"}
    assert (got["o1"]["wait_time"], got["o1"]["expected_wait_time"], got["o1"]["delay_vs_expected"]) == (10.5, 14.0, 0.0)
    assert (got["o2"]["wait_time"], got["o2"]["delay_vs_expected"]) == (17.25, 3.25)
    assert got["o3"]["wait_time"] is None and got["o3"]["delay_vs_expected"] == 0.0


def test_f1_all_statuses(f1):
    got = {r["order_id"]: r for r in rows(orders.wait_time(f1, is_delivered=False))}
    assert got["o4"]["wait_time"] == 1.0 and got["o4"]["delay_vs_expected"] == 0.0


def test_f1_legacy_keeps_null_and_ignores_argument(f1):
    got = {r["order_id"]: r for r in rows(orders.wait_time(f1, is_delivered=False, legacy=True))}
    assert set(got) == {"o1", "o2", "o3"}
    assert got["o3"]["delay_vs_expected"] is None
    assert got["o2"]["delay_vs_expected"] == 3.25


# F2 fan-out ----------------------------------------------------------------

@pytest.fixture(scope="module")
def f2(spark):
    t0 = ts("2017-01-01 00:00:00")

    def order(oid, days):
        return dict(order_id=oid, customer_id="c1", order_status="delivered",
                    order_purchase_timestamp=t0, order_approved_at=t0,
                    order_delivered_carrier_date=t0,
                    order_delivered_customer_date=ts(f"2017-01-{1 + days:02d} 00:00:00"),
                    order_estimated_delivery_date=ts("2017-01-30 00:00:00"))

    def item(oid, n):
        return dict(order_id=oid, order_item_id=n, product_id="p1", seller_id="s1",
                    shipping_limit_date=t0, price=money(10), freight_value=money(1))

    return market(
        spark,
        orders=[order("o1", 10), order("o2", 4), order("o3", 7)],
        order_items=[item("o1", 1), item("o1", 2), item("o2", 1)],
        order_reviews=[dict(review_id="r1", order_id="o1", review_score=5),
                       dict(review_id="r2", order_id="o1", review_score=1),
                       dict(review_id="r3", order_id="o3", review_score=3)],
        sellers=[dict(seller_id="s1", seller_zip_code_prefix="1", seller_city="x",
                      seller_state="SP")],
        products=[dict(product_id="p1", product_category_name="cat")],
        category_translation=[dict(product_category_name="cat",
                                   product_category_name_english="category")],
    )


def test_f2_link_table_fans_out(f2):
    assert link.link_table(f2).count() == 6


def test_f2_order_mart_one_row_per_review(f2):
    got = rows(orders.order_features(f2))
    assert [r["order_id"] for r in got] == ["o1", "o1"]
    assert {(r["number_of_products"], r["number_of_sellers"]) for r in got} == {(2, 1)}


def test_f2_seller_review_scores_dedupe_pairs(f2):
    (r,) = rows(sellers.review_scores(f2))
    assert (r["review_score"], r["share_of_one_stars"], r["share_of_five_stars"]) == (3.0, 0.5, 0.5)


def test_f2_seller_quantity(f2):
    (r,) = rows(sellers.quantity(f2))
    assert (r["n_orders"], r["quantity"], r["quantity_per_order"]) == (2, 3, 1.5)


def test_f2_review_costs(f2):
    (r,) = rows(sellers.costs(f2, Rates(it_total=0.0)))
    assert r["costs"] == 100.0
    (p,) = rows(products.costs(f2))
    assert p["costs"] == 75.0


def test_f2_product_wait_weighted_by_reviews(f2):
    (r,) = rows(products.wait_time(f2))
    assert r["wait_time"] == pytest.approx(8.8, **APPROX)
    (mart,) = rows(products.product_mart(f2))
    assert mart["wait_time"] == pytest.approx(8.8, **APPROX)


def test_f2_fused_seller_mart_matches_parts(f2):
    (mart,) = rows(sellers.seller_mart(f2))
    assert (mart["review_score"], mart["share_of_one_stars"]) == (3.0, 0.5)
    assert (mart["n_orders"], mart["quantity"], mart["quantity_per_order"]) == (2, 3, 1.5)
    # the only seller carries the whole IT cost
    assert mart["costs"] == pytest.approx(500_000 + 100, **APPROX)


# F3 keyed profit -----------------------------------------------------------

def test_f3_profits_are_keyed(spark):
    t0 = ts("2017-03-01 10:00:00")
    m = market(
        spark,
        orders=[dict(order_id=f"o{s}", customer_id="c", order_status="delivered",
                     order_purchase_timestamp=t0, order_approved_at=t0,
                     order_delivered_customer_date=t0) for s in "ABC"],
        order_items=[dict(order_id=f"o{s}", order_item_id=1, product_id="p",
                          seller_id=s, price=money(1000)) for s in "ABC"],
        order_reviews=[dict(review_id="rA", order_id="oA", review_score=5),
                       dict(review_id="rC", order_id="oC", review_score=1)],
    )
    rates = Rates(it_total=300.0)
    assert {r["seller_id"]: r["revenues"] for r in rows(sellers.revenues(m, rates))} == {
        "A": 180.0, "B": 180.0, "C": 180.0}
    assert {r["seller_id"]: r["costs"] for r in rows(sellers.costs(m, rates))} == pytest.approx(
        {"A": 100.0, "C": 200.0})
    assert {r["seller_id"]: r["profits"] for r in rows(sellers.profits(m, rates))} == pytest.approx(
        {"A": 80.0, "C": -20.0})


# F4 first point -------------------------------------------------------------

@pytest.fixture(scope="module")
def f4(spark):
    return market(
        spark,
        geolocation=[
            dict(geolocation_zip_code_prefix="1", geolocation_lat=None, geolocation_lng=10.0,
                 geolocation_city="z", geolocation_state="SP", seq=0),
            dict(geolocation_zip_code_prefix="1", geolocation_lat=5.0, geolocation_lng=11.0,
                 geolocation_city="z", geolocation_state="SP", seq=1),
            dict(geolocation_zip_code_prefix="2", geolocation_lat=1.0, geolocation_lng=1.0,
                 geolocation_city="x", geolocation_state="SP", seq=2),
            dict(geolocation_zip_code_prefix="3", geolocation_lat=2.0, geolocation_lng=2.0,
                 geolocation_city="x", geolocation_state="RJ", seq=3),
        ],
        sellers=[dict(seller_id="s1", seller_zip_code_prefix="2", seller_city="x", seller_state="SP"),
                 dict(seller_id="s2", seller_zip_code_prefix="3", seller_city="x", seller_state="RJ")],
    )


def test_f4_first_non_null_per_column(f4):
    got = {r["geolocation_zip_code_prefix"]: (r["geolocation_lat"], r["geolocation_lng"])
           for r in rows(first_point(f4.geolocation, "geolocation_zip_code_prefix"))}
    assert got["1"] == (5.0, 10.0)


def test_f4_city_point_ignores_state_and_row_order(f4):
    shuffled = f4.geolocation.orderBy(F.rand(7)).repartition(3)
    for geo in (f4.geolocation, shuffled):
        m = type(f4)(**{**f4.__dict__, "geolocation": geo})
        got = {r["seller_id"]: (r["geolocation_lat"], r["geolocation_lng"])
               for r in rows(sellers.seller_features(m))}
        assert got == {"s1": (1.0, 1.0), "s2": (1.0, 1.0)}


# F5 NULL keys and empty sums -----------------------------------------------

def test_f5_null_keys_and_empty_sums(spark):
    t0 = ts("2017-05-01 00:00:00")
    m = market(
        spark,
        orders=[dict(order_id=o, customer_id="c", order_status="delivered",
                     order_purchase_timestamp=t0, order_approved_at=t0,
                     order_delivered_customer_date=t0) for o in ("o1", "o2")],
        order_items=[dict(order_id="o2", order_item_id=1, product_id="p9", seller_id="s9",
                          price=None)],
        order_reviews=[dict(review_id="r1", order_id="o1", review_score=4),
                       dict(review_id="r2", order_id="o2", review_score=2)],
    )
    for df in (sellers.active_dates(m), sellers.review_scores(m), sellers.costs(m)):
        assert all(r["seller_id"] is not None for r in rows(df))
    for df in (products.wait_time(m), products.review_scores(m)):
        assert all(r["product_id"] is not None for r in rows(df))
    assert rows(sellers.sales(m)) == [{"seller_id": "s9", "sales": 0.0}]


# F6 active months ------------------------------------------------------------

def test_f6_active_months(spark):
    pairs = {
        "sA": ["2017-01-01 00:00:00", "2017-01-31 10:29:06"],
        "sB": ["2017-01-01 00:00:00", "2017-01-31 10:29:05"],
        "sC": ["2017-01-01 00:00:00"],
        "sD": [None],
    }
    order_rows, item_rows = [], []
    for s, dates in pairs.items():
        for i, d in enumerate(dates):
            oid = f"{s}{i}"
            order_rows.append(dict(order_id=oid, order_status="shipped", order_approved_at=ts(d)))
            item_rows.append(dict(order_id=oid, order_item_id=1, seller_id=s, price=money(1)))
    m = market(spark, orders=order_rows, order_items=item_rows)
    got = {r["seller_id"]: r["active_months"] for r in rows(sellers.active_dates(m))}
    assert got == {"sA": 2.0, "sB": 1.0, "sC": 1.0, "sD": None}
    rev = {r["seller_id"]: r["revenues"] for r in rows(sellers.revenues(m))}
    assert rev["sD"] is None


# F7 double rounding --------------------------------------------------------

def test_f7_round_to_one_then_zero_half_even(spark):
    df = spark.createDataFrame([(1.46,), (2.45,), (0.45,)], "x double")
    got = [r[0] for r in df.select(round_half_even(round_half_even(F.col("x"), 1), 0)).collect()]
    assert got == [2.0, 2.0, 0.0]


# F8 CSV catalog --------------------------------------------------------------

def test_f8_csv_catalog(spark, tmp_path):
    from souk.sources.catalog import read_csv_catalog

    (tmp_path / "shop_orders_data.csv").write_text(
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
        "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
        "o1,c1,delivered,2017-10-02 10:56:33,,not a date,2017-10-10 21:25:13,2017-10-18 00:00:00\n"
    )
    (tmp_path / "shop_order_reviews_data.csv").write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        'r1,o1,0,,"line one\nline two, with ""quotes""",2017-10-11 00:00:00,2017-10-12 03:43:48\n'
        "r2,o1,6,,,2017-10-11 00:00:00,2017-10-12 03:43:48\n"
    )
    (tmp_path / "product_category_name_translation.csv").write_text(
        "product_category_name,product_category_name_english\nbeleza_saude,health_beauty\n"
    )
    (tmp_path / "notes.txt").write_text("not a table\n")
    tables = read_csv_catalog(spark, str(tmp_path), "shop_", "_data")
    assert set(tables) == {"orders", "order_reviews", "product_category_name_translation"}
    (o,) = rows(tables["orders"])
    assert o["order_approved_at"] is None and o["order_delivered_carrier_date"] is None
    assert o["order_purchase_timestamp"] == ts("2017-10-02 10:56:33")
    revs = rows(tables["order_reviews"], "review_id")
    assert len(revs) == 2
    assert revs[0]["review_comment_message"] == 'line one\nline two, with "quotes"'
    m = market(spark)
    m = type(m)(**{**m.__dict__, "order_reviews": tables["order_reviews"]})
    bad = {r["review_score"]: r["n_reviews"] for r in rows(reviews.bad_scores(m))}
    assert bad == {0: 1, 6: 1}
    stats = rows(reviews.order_review_stats(m))
    assert stats[0]["seller_review_cost"] == 0.0


# F9 ranking ------------------------------------------------------------------

def _mart(spark, profits):
    data = [(f"s{i:02d}", "city", "ST", float(p) if p is not None else None, 100.0, 2)
            for i, p in enumerate(profits)]
    return spark.createDataFrame(
        data, "seller_id string, seller_city string, seller_state string, profits double, "
              "sales double, n_orders long")


def test_f9_removal_curve(spark):
    ranked = segments.ranked_sellers(_mart(spark, [10, 5, -3]))
    got = {r["n_sellers_removed"]: r["benefits_of_removing"]
           for r in rows(segments.removal_gain_curve(ranked))}
    assert got == pytest.approx({0: 0.0, 1: 25.0, 2: -16.666666666666668})


def test_f9_segments_and_cohorts(spark):
    profits = [9, 3, 3, 3, -1, 7, 0, 5, None, 2]
    ranked = segments.ranked_sellers(_mart(spark, profits), segments.Cutoffs(2, 4, 7))
    sizes = {r["profile"]: r["n_sellers"] for r in rows(segments.segment_sizes(segments.seller_segments(ranked)))}
    assert sizes == {"Worst": 2, "Bad": 2, "Neutral": 3, "Good": 3}
    cohorts = rows(segments.seller_cohorts(ranked).groupBy("cohort").count())
    assert {r["cohort"]: r["count"] for r in cohorts} == {"worst": 2, "bad": 4, "neutral": 7, "good": 3}
    by_rank = {r["profit_rank"]: r["seller_id"] for r in rows(ranked)}
    # best first; the three tied profits of 3 are ordered by seller_id
    assert [by_rank[k] for k in range(1, 11)] == [
        "s00", "s05", "s07", "s01", "s02", "s03", "s09", "s06", "s04", "s08"]


def test_wait_time_of_an_order_with_millions_of_reviews(spark):
    m = market(
        spark,
        orders=[dict(order_id="o1", customer_id="c1", order_status="delivered",
                     order_purchase_timestamp=ts("2017-01-01 00:00:00"),
                     order_delivered_customer_date=ts("2017-01-31 00:00:00"))],
        order_items=[dict(order_id="o1", order_item_id=1, product_id="p1", seller_id="s1", price=money(1))],
        products=[dict(product_id="p1", product_category_name="c")],
        category_translation=[dict(product_category_name="c", product_category_name_english="c")],
    )
    reviews_ = spark.range(4_000_000).select(
        *(F.lit("o1").alias(f.name) if f.name == "order_id"
          else F.lit(5 if f.name == "review_score" else None).cast(f.dataType).alias(f.name)
          for f in schemas.ORDER_REVIEWS.fields)
    ).withColumn("review_id", F.lit("r"))
    m = type(m)(**{**m.__dict__, "order_reviews": reviews_})
    assert [r["wait_time"] for r in rows(products.wait_time(m))] == [30.0]
    assert [r["wait_time"] for r in rows(products.product_mart(m))] == [30.0]
