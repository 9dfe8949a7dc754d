from __future__ import annotations

import os
import sys
import tempfile
from datetime import datetime
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql.types import LongType, StructField, StructType  # noqa: E402

from souk.session import build_session  # noqa: E402
from souk.sources import schemas  # noqa: E402
from souk.sources.catalog import GEO_ORDER, Marketplace  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    folder = tempfile.mkdtemp(prefix="souk-tests-")
    return build_session(
        "local[4]", shuffle_partitions=4, app_name="souk-tests",
        extra={"spark.checkpoint.dir": folder},
    )


GEO_SCHEMA = StructType(schemas.GEOLOCATION.fields + [StructField(GEO_ORDER, LongType())])


def ts(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def money(x) -> Decimal | None:
    return None if x is None else Decimal(str(x))


def frame(spark: SparkSession, schema: StructType, rows: list[dict]) -> DataFrame:
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def market(spark: SparkSession, **tables: list[dict]) -> Marketplace:
    """Marketplace from literal rows; unspecified tables are empty."""
    spec = {
        "orders": schemas.ORDERS,
        "order_items": schemas.ORDER_ITEMS,
        "order_reviews": schemas.ORDER_REVIEWS,
        "customers": schemas.CUSTOMERS,
        "sellers": schemas.SELLERS,
        "products": schemas.PRODUCTS,
        "geolocation": GEO_SCHEMA,
        "category_translation": schemas.CATEGORY_TRANSLATION,
    }
    return Marketplace(
        **{name: frame(spark, schema, tables.get(name, [])) for name, schema in spec.items()}
    )


def rows(df: DataFrame, key: str | None = None) -> list[dict]:
    out = [r.asDict() for r in df.collect()]
    if key:
        out.sort(key=lambda r: (r[key] is None, r[key]))
    return out
