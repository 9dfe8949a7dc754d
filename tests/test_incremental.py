"""Marts refreshed from changed orders equal marts built anew."""

from __future__ import annotations

from dataclasses import replace

import pytest
from conftest import SF_SMALL, market, money, ts
from pyspark.sql import functions as F

from souk.operators import products, replay, sellers
from souk.operators.incremental import PRODUCTS, SELLERS, MartStore
from souk.registry import marketplace
from souk.sources.export import shared_path


def rows_of(df):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


SPECS = [(SELLERS, sellers.seller_mart), (PRODUCTS, products.product_mart)]


@pytest.mark.parametrize("spec, whole", SPECS, ids=["sellers", "products"])
def test_refreshed_in_steps_equals_built(spark, spec, whole):
    m = marketplace(spark, SF_SMALL)
    store = MartStore(spark, shared_path(spark, "mart-test"), spec)
    before = replay.earlier(m)
    store.build(before)
    assert rows_of(store.mart(m)) == rows_of(whole(before))
    # first half of the changes, then all of them
    ids = replay.changed_orders(m)
    half = ids.filter(F.col("order_id") % 2 == 0)
    between = replace(
        before,
        **{
            name: getattr(before, name).join(half, "order_id", "left_anti").unionByName(
                getattr(m, name).join(half, "order_id", "left_semi")
            )
            for name in ("orders", "order_items", "order_reviews")
        },
    )
    store.refresh(between, half)
    assert rows_of(store.mart(m)) == rows_of(whole(between))
    store.refresh(m, ids)
    assert store.batches() == 3
    assert rows_of(store.mart(m)) == rows_of(whole(m))
    assert rows_of(store.compacted(shared_path(spark, "mart-test")).mart(m)) == rows_of(whole(m))


def small(spark, items, days):
    orders = [
        {"order_id": o, "customer_id": "c", "order_status": "delivered", "order_purchase_timestamp": ts(f"2018-01-{d:02d}"),
         "order_approved_at": ts(f"2018-01-{d:02d}"), "order_delivered_carrier_date": ts("2018-02-01"),
         "order_delivered_customer_date": ts("2018-02-02"), "order_estimated_delivery_date": ts("2018-02-03")}
        for o, d in days.items()
    ]
    return market(
        spark,
        orders=orders,
        order_items=[
            {"order_id": o, "order_item_id": i, "product_id": "p", "seller_id": s, "price": money(10), "freight_value": money(1)}
            for i, (o, s) in enumerate(items)
        ],
        order_reviews=[{"review_id": f"r{o}", "order_id": o, "review_score": 1} for o in days],
        sellers=[{"seller_id": s, "seller_zip_code_prefix": "1", "seller_city": "x", "seller_state": "Y"} for s in "abc"],
    )


def ids(spark, *orders):
    return spark.createDataFrame([(o,) for o in orders], "order_id string")


def test_only_changed_entities_get_rows_and_dates_are_found_again(spark):
    first = small(spark, [("1", "a"), ("2", "a"), ("3", "b"), (None, "b")], {"1": 5, "2": 9, "3": 7})
    store = MartStore(spark, shared_path(spark, "mart-test"), SELLERS)
    store.build(first)
    # order 1 leaves seller a (whose first date it held) for c
    second = small(spark, [("1", "c"), ("2", "a"), ("3", "b"), (None, "b")], {"1": 5, "2": 9, "3": 7})
    store.refresh(second, ids(spark, "1", "1", None, "gone"))
    assert {r["seller_id"] for r in store._read("totals", range(1, 2)).collect()} == {"a", "c"}
    got = {r["seller_id"]: (r["first_approved"], r["n_orders"], r["n_items"]) for r in store.totals().collect()}
    assert got == {"a": (ts("2018-01-09"), 1, 1), "b": (ts("2018-01-07"), 1, 1), "c": (ts("2018-01-05"), 1, 1)}
    # order 2 loses its item: seller a has nothing left
    third = small(spark, [("1", "c"), ("3", "b"), (None, "b")], {"1": 5, "2": 9, "3": 7})
    store.refresh(third, ids(spark, "2"))
    assert {r["seller_id"] for r in store.totals().collect()} == {"b", "c"}
    assert rows_of(store.mart(third)) == rows_of(sellers.seller_mart(third))


def test_a_batch_cut_short_is_written_over(spark):
    m = small(spark, [("1", "a"), ("2", "b")], {"1": 5, "2": 9})
    store = MartStore(spark, shared_path(spark, "mart-test"), SELLERS)
    with pytest.raises(ValueError, match="nothing is built"):
        store.refresh(m, ids(spark, "1"))
    store.build(m)
    now = small(spark, [("1", "a"), ("1", "a"), ("2", "b")], {"1": 5, "2": 9})
    # as if the refresh had ended after its pairs
    store._write(store._contributions(now, 1), "pairs", 1)
    store._write(ids(spark, "1", "2").withColumn("batch", F.lit(1)), "changed", 1)
    assert rows_of(store.mart(m)) == rows_of(sellers.seller_mart(m))
    store.refresh(now, ids(spark, "1"))
    assert rows_of(store.mart(now)) == rows_of(sellers.seller_mart(now))
