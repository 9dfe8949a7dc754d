"""End to end through the CSV source: model tables written as CSV files
with their catalog names, read back (string keys, file-order geolocation),
marts compared with the Parquet path."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from souk.operators import orders, products, sellers
from souk.registry import marketplace
from souk.sources.catalog import (
    GEO_ORDER,
    load_csv_marketplace,
    read_csv_catalog,
    read_csv_table,
    table_key,
)

PREFIX, SUFFIX = "shop_", "_data"
FILES = {
    table: f"{PREFIX}{table}{SUFFIX}.csv"
    for table in ("orders", "order_items", "order_reviews", "customers", "sellers",
                  "products", "geolocation")
}
FILES["category_translation"] = "product_category_name_translation.csv"


def _write_csv(df, path):
    pdf = df.toPandas()
    for c in pdf.columns:
        if str(pdf[c].dtype).startswith("datetime64"):
            pdf[c] = pdf[c].dt.strftime("%Y-%m-%d %H:%M:%S")
    pdf.to_csv(path, index=False)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    m = marketplace(spark, SF_SMALL)
    d = tmp_path_factory.mktemp("csv")
    for table, name in FILES.items():
        df = getattr(m, table)
        if table == "geolocation":
            df = df.orderBy(GEO_ORDER).drop(GEO_ORDER)
        _write_csv(df, d / name)
    return m, load_csv_marketplace(spark, str(d), PREFIX, SUFFIX)


def _keyed(df, keys):
    out = df
    for k in keys:
        out = out.withColumn(k, F.col(k).cast("string"))
    return sorted(
        tuple(round(v, 6) if isinstance(v, float) else v for v in r)
        for r in out.select(sorted(out.columns)).collect()
    )


def test_catalog_keys(both):
    _, csv = both
    assert csv.order_items.schema["order_id"].dataType.simpleString() == "string"
    assert csv.order_items.schema["price"].dataType.simpleString() == "decimal(18,3)"


def test_seller_mart_same_through_csv(both):
    pq, csv = both
    assert _keyed(sellers.seller_mart(pq), ["seller_id"]) == _keyed(
        sellers.seller_mart(csv), ["seller_id"])


def test_product_mart_same_through_csv(both):
    pq, csv = both
    assert _keyed(products.product_mart(pq), ["product_id"]) == _keyed(
        products.product_mart(csv), ["product_id"])


def test_distance_same_through_csv(both):
    pq, csv = both
    assert _keyed(orders.seller_customer_distance(pq), ["order_id"]) == _keyed(
        orders.seller_customer_distance(csv), ["order_id"])


CUSTOMERS = "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state"


def test_columns_go_by_header_name_and_files_of_a_key_add_up(spark, tmp_path):
    (tmp_path / "customers.csv").write_text(f"{CUSTOMERS}\nc1,u1,123,town,AA\n")
    (tmp_path / "customers_data.csv").write_text(
        "customer_state,extra,customer_city,customer_id,customer_zip_code_prefix,customer_unique_id\n"
        "BB,x,city,c2,456,u2\nBB,x,city,c3,456,u3\n"
    )
    df = read_csv_table(spark, str(tmp_path / "customers_data.csv"), "customers")
    got = {r["customer_id"]: (r["customer_state"], r["customer_city"]) for r in df.collect()}
    assert got == {"c2": ("BB", "city"), "c3": ("BB", "city")} and "extra" not in df.columns
    with pytest.raises(ValueError, match="different headers"):
        read_csv_catalog(spark, str(tmp_path), suffix="_data")
    (tmp_path / "customers.csv").write_text(f"extra,{CUSTOMERS}\nx,c1,u1,123,town,AA\n")
    both = read_csv_catalog(spark, str(tmp_path), suffix="_data")["customers"]
    assert sorted(r["customer_id"] for r in both.collect()) == ["c1", "c2", "c3"]


def test_a_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "customers.csv").write_text("customer_id,customer_city\nc1,town\n")
    with pytest.raises(ValueError, match="lacks the columns"):
        read_csv_catalog(spark, str(tmp_path))


def test_prefix_and_suffix_go_at_the_ends_only():
    assert table_key("/x/a_b_a_c.csv", "a_", "_c") == "b_a"
