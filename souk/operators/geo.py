"""Representative geolocation point per zip code or city."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.plans.skew import HotKeys, salted_join
from souk.sources.catalog import GEO_ORDER

LAT, LNG = "geolocation_lat", "geolocation_lng"


def first_point(geolocation: DataFrame, key: str, order: str = GEO_ORDER) -> DataFrame:
    """First non-NULL latitude and, independently, first non-NULL longitude
    per ``key`` in file order (``order``); NULL keys are dropped.

    ``min_by`` skips rows whose ordering value is NULL, so masking the order
    where the coordinate is NULL yields the first non-NULL coordinate. It is
    a partial (map-side) aggregate: a hot zip or city never reaches a
    reducer as more than one row per map task.
    """
    def first(c: str):
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)

    return (
        geolocation.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(first(LAT), first(LNG))
    )


def locate(
    entities: DataFrame, zip_col: str, geolocation: DataFrame, hot: HotKeys | None = None
) -> DataFrame:
    """``entities`` left-joined to the first point of their zip code (a zip
    holding a large share of the entities is split over several tasks)."""
    points = first_point(geolocation, "geolocation_zip_code_prefix").withColumnRenamed(
        "geolocation_zip_code_prefix", zip_col
    )
    spread = [c for c in entities.columns if c != zip_col]
    return salted_join(entities, points, zip_col, "left", spread_by=spread, other_unique=True, hot=hot)
