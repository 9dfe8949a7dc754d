"""The marketplace catalog: one lazy DataFrame per table.

``Marketplace`` is the value every operator takes. Nothing is loaded inside
an operator, so one catalog feeds any number of marts and Spark scans each
file only when an action runs (the caller may ``persist()`` shared marts).

``read_csv_catalog`` lists ``*.csv`` files of a directory, derives each
table key from the file name and reads every file with its declared schema.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, fields
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from souk.plans.skew import HotKeys, sketch, tasks_for
from souk.sources.records import MAX_RECORD, Records, file_headers, records
from souk.sources.schemas import MULTILINE_TABLES, TABLE_SCHEMAS

# Column that fixes the file order of geolocation rows ("first" point per
# zip or city is the first one in this order).
GEO_ORDER = "seq"

FILE_EXT = ".csv"

_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


# Table -> its columns that joins go by, and the columns that tell rows apart.
SKETCHED = {
    "orders": (["customer_id"], ["order_id"]),
    "order_items": (["order_id", "product_id", "seller_id"], ["order_id", "order_item_id", "product_id", "seller_id"]),
    "order_reviews": (["order_id"], ["order_id", "review_id"]),
    "sellers": (["seller_zip_code_prefix", "seller_city"], ["seller_id"]),
    "customers": (["customer_zip_code_prefix"], ["customer_id"]),
    "products": (["product_category_name"], ["product_id"]),
}

# The sketches made so far, for as long as their catalog is in use.
_SKETCHES: WeakKeyDictionary[Marketplace, dict] = WeakKeyDictionary()


@dataclass(frozen=True)
class Marketplace:
    """Lazy base tables of the marketplace model (see ``schemas``)."""

    orders: DataFrame
    order_items: DataFrame
    order_reviews: DataFrame
    customers: DataFrame
    sellers: DataFrame
    products: DataFrame
    geolocation: DataFrame  # carries the GEO_ORDER column
    category_translation: DataFrame
    order_payments: DataFrame | None = None

    def hot(self, table: str, column: str) -> HotKeys:
        """The keys of a base table's column that hold very many rows. A table's
        key columns are sketched in one pass, when the first is asked for, and
        every join over this catalog shares the sketch."""
        known = _SKETCHES.setdefault(self, {})
        if table not in known:
            columns, identity = SKETCHED[table]
            known[table] = sketch(getattr(self, table), columns, identity)
        return known[table][column]

    def order_tasks(self) -> int | None:
        """Partitions for work by order, from the largest of the tables that have
        rows by order (None: one task may take them all)."""
        tables = ("orders", "order_items", "order_reviews")
        rows = max(self.hot(t, SKETCHED[t][0][0]).rows for t in tables)
        return tasks_for(self.orders.sparkSession, rows)

    @classmethod
    def from_tables(cls, tables: dict[str, DataFrame]) -> "Marketplace":
        names = {f.name for f in fields(cls)}
        picked = {k: v for k, v in tables.items() if k in names}
        if "product_category_name_translation" in tables:
            picked["category_translation"] = tables["product_category_name_translation"]
        return cls(**picked)


def table_key(file_name: str, prefix: str = "", suffix: str = "") -> str:
    """Catalog key of a CSV file: its name without extension and without the
    given prefix and suffix."""
    name = posixpath.basename(file_name).removesuffix(FILE_EXT)
    return name.removeprefix(prefix).removesuffix(suffix)


def _file_order() -> Column:
    # Rows of one file split keep their file order in the id; splits of a
    # file are ordered by their start offset, files by path. The id alone is
    # not enough: Spark orders splits by size, not by position.
    return F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    )


_CSV_OPTIONS = {
    "escape": '"',
    "mode": "PERMISSIVE",
    "timestampNTZFormat": _TIMESTAMP_FORMAT,
}
_CORRUPT = "_corrupt"


def _ddl(columns: list[tuple[str, DataType]]) -> str:
    return ", ".join(f"`{name}` {kind.simpleString()}" for name, kind in columns)


def _declared(key: str, headers: list[list[str]]) -> tuple[list[str], dict[str, DataType]]:
    """The columns that a table has, in order, and the declared types."""
    if not headers:
        raise ValueError(f"table {key!r} has no file with a header")
    if len({frozenset(h) for h in headers}) > 1 or any(len(set(h)) < len(h) for h in headers):
        raise ValueError(f"files of table {key!r} have different headers or repeated columns: {headers}")
    schema = TABLE_SCHEMAS.get(key)
    names = [f.name for f in schema.fields] if schema is not None else headers[0]
    missing = [n for n in names if n not in headers[0]]
    if missing:
        raise ValueError(f"table {key!r} lacks the columns {missing}")
    return names, {f.name: f.dataType for f in schema.fields} if schema is not None else {}


def _parsed(found: Records, names: list[str], kinds: dict[str, DataType]) -> DataFrame:
    """Records with ``v``, the declared columns in their types (NULL where a
    value is malformed), ``s``, the same columns as text, and ``whole``, whether
    the record has a value for each column of its header and no more."""

    def struct(typed: bool) -> Column:
        out = F.lit(None)
        for i, header in enumerate(found.headers):
            # columns go by place: a header may hold any name
            columns = [(f"c{j}", kinds.get(c, StringType()) if typed else StringType()) for j, c in enumerate(header)]
            record = F.from_csv(
                F.col("record").cast("string"),
                _ddl([*columns, (_CORRUPT, StringType())]),
                _CSV_OPTIONS | {"multiLine": "true", "columnNameOfCorruptRecord": _CORRUPT},
            )
            fields = [record[f"c{header.index(c)}"].alias(c) for c in names]
            out = F.when(F.col("header") == i, F.struct(*fields, record[_CORRUPT].alias(_CORRUPT))).otherwise(out)
        return out

    return found.rows.withColumns({"v": struct(True), "s": struct(False)})


def _rejects(parsed: DataFrame, names: list[str], max_record: int) -> DataFrame:
    """One row for each malformed value, or for a record that is malformed as
    a whole: (path, offset, column, reason, raw)."""

    def fault(condition: Column, column: str | None, reason: str, raw: Column) -> Column:
        one = F.struct(
            F.lit(column).cast("string").alias("column"), F.lit(reason).alias("reason"), raw.cast("string").alias("raw")
        )
        return F.when(condition, F.array(one)).otherwise(F.array().cast("array<struct<column:string,reason:string,raw:string>>"))

    text, s, v = F.col("record"), F.col("s"), F.col("v")
    faults = F.concat(
        fault(text.isNull(), None, f"longer than {max_record} bytes", F.lit(None)),
        fault(text.isNotNull() & s[_CORRUPT].isNotNull(), None, "number of fields", text),
        *(fault(s[c].isNotNull() & v[c].isNull(), c, "value", s[c]) for c in names),
    )
    return parsed.select("path", "offset", F.explode(faults).alias("f")).select("path", "offset", "f.*")


def read_csv_with_rejects(
    spark: SparkSession, path: str | list[str], key: str, max_record: int = MAX_RECORD
) -> tuple[DataFrame, DataFrame]:
    """The rows of one table's CSV file(s), as ``read_csv_table`` gives them, and
    its rejects: what in the files is malformed.

    Rejects are (path, offset, column, reason, raw): the file, the byte at which
    the record starts, and for a malformed value its column and text; for a
    record with too few or too many fields the column is NULL and the text is
    the record's. Such a record still makes a row of the values it has. A record
    of more than ``max_record`` bytes makes no row and has no text.

    Quoted line breaks may stand in any table, and every file is read by many
    tasks (``souk.sources.records``).
    """
    paths = [path] if isinstance(path, str) else list(path)
    found = records(spark, paths, max_record)
    names, kinds = _declared(key, found.headers)
    parsed = _parsed(found, names, kinds)
    columns = [F.col("v")[c].alias(c) for c in names]
    if key == "geolocation":
        columns.append(F.struct(F.col("path"), F.col("offset"), F.lit(0).cast("long")).alias(GEO_ORDER))
    rows = parsed.filter(F.col("record").isNotNull()).select(*columns)
    return rows, _rejects(parsed, names, max_record)


def read_csv_table(spark: SparkSession, path: str | list[str], key: str) -> DataFrame:
    """Read the CSV file(s) of one table with the declared schema of ``key``.

    Columns go by header name, whatever their order; a missing declared
    column is an error, and so are files of one table with different
    headers. Undeclared columns are left out; unknown tables are read as all
    strings. Malformed values (bad timestamps, non-numeric text) become NULL
    (``read_csv_with_rejects`` lists them).

    All headers are read in one job, and files whose columns stand in the same
    order make one scan. Tables that may hold quoted line breaks are cut at
    record ends found in parallel, so that a file is read by many tasks.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if key in MULTILINE_TABLES:
        return read_csv_with_rejects(spark, paths, key)[0]
    headers = file_headers(spark, paths)
    names, kinds = _declared(key, list(headers.values()))
    if key == "geolocation":
        names = [*names, GEO_ORDER]
    same: dict[tuple[str, ...], list[str]] = {}
    for p, header in headers.items():
        same.setdefault(tuple(header), []).append(p)
    parts = []
    for header, files in same.items():
        in_order = StructType([StructField(c, kinds.get(c, StringType()), True) for c in header])
        df = spark.read.options(header=True, **_CSV_OPTIONS).schema(in_order).csv(files)
        if key == "geolocation":
            df = df.withColumn(GEO_ORDER, _file_order())
        parts.append(df.select(*names))
    return reduce(DataFrame.unionByName, parts)


def list_csv_files(spark: SparkSession, directory: str) -> list[str]:
    """Paths of the ``*.csv`` files directly inside ``directory``.

    The listing goes through Spark's file source, so it works on any
    Hadoop-compatible file system; file contents are not read.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .load(directory)
        .select("path")
    )
    return sorted(row.path for row in listing.collect())


def read_csv_catalog(
    spark: SparkSession, directory: str, prefix: str = "", suffix: str = ""
) -> dict[str, DataFrame]:
    """The CSV files of ``directory`` as DataFrames by table key (see
    ``table_key``); all files of one key make one table."""
    by_key: dict[str, list[str]] = {}
    for path in list_csv_files(spark, directory):
        by_key.setdefault(table_key(path, prefix, suffix), []).append(path)
    return {key: read_csv_table(spark, paths, key) for key, paths in by_key.items()}


def load_csv_marketplace(
    spark: SparkSession, directory: str, prefix: str = "", suffix: str = ""
) -> Marketplace:
    return Marketplace.from_tables(read_csv_catalog(spark, directory, prefix, suffix))
