"""Write a skewed copy of a driver table set for robustness checks.

    python scripts/make_skewed.py SRC_DIR DST_DIR

Every third item is moved to one hot seller (7) and every fifth item to
one hot order (1), half of those items to one product (7); every third order
to one customer (7), every third part to one type, and every third seller and
customer lose their place. The other tables are copied unchanged. Then

    python scripts/check_oracle.py --sf DST_DIR

checks every query against DuckDB on data where one key holds a third of
all rows.
"""

from __future__ import annotations

import shutil
import sys

import pyarrow as pa
import pyarrow.parquet as pq

HOT_SELLER, HOT_ORDER, HOT_PRODUCT, HOT_CUSTOMER = 7, 1, 7, 7
UNCHANGED = ("region", "nation")


def _every(table: pa.Table, column: str, step: int, rest: int, value) -> pa.Table:
    """``table`` with ``value`` in ``column`` of every ``step``-th row."""
    col = table[column].to_pylist()
    col[rest::step] = [value] * len(col[rest::step])
    at = table.schema.get_field_index(column)
    return table.set_column(at, column, pa.array(col, table.schema.field(column).type))


def make_skewed(src: str, dst: str) -> None:
    for t in UNCHANGED:
        shutil.copy(f"{src}/{t}.parquet", f"{dst}/{t}.parquet")
    part = pq.read_table(f"{src}/part.parquet")
    changes = {
        "lineitem": [
            ("l_suppkey", 3, 0, HOT_SELLER),
            ("l_orderkey", 5, 1, HOT_ORDER),
            ("l_partkey", 10, 1, HOT_PRODUCT),
        ],
        "orders": [("o_custkey", 3, 1, HOT_CUSTOMER)],
        "part": [("p_type", 3, 1, part["p_type"][0].as_py())],
        "supplier": [("s_nationkey", 3, 1, None)],
        "customer": [("c_nationkey", 3, 1, None)],
    }
    for name, columns in changes.items():
        table = pq.read_table(f"{src}/{name}.parquet")
        for change in columns:
            table = _every(table, *change)
        pq.write_table(table, f"{dst}/{name}.parquet")


if __name__ == "__main__":
    make_skewed(sys.argv[1], sys.argv[2])
