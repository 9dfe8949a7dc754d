"""Output canonicalisation for cross-engine comparison.

Doubles are rounded to 6 decimals with the same IEEE operations DuckDB
uses in ``souk.oracle.canonical_sql`` (multiply, round half to even,
divide), and -0.0 is folded to 0.0. Sums taken in a different order differ
in the last bits; this makes both engines print the same value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def double_columns(df: DataFrame) -> tuple[str, ...]:
    return tuple(f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType))


def canonical(df: DataFrame) -> DataFrame:
    replaced = {}
    for name in double_columns(df):
        r = F.rint(F.col(name) * 1_000_000.0) / 1_000_000.0
        replaced[name] = F.when(r == 0, F.lit(0.0)).otherwise(r)
    return df.withColumns(replaced) if replaced else df
