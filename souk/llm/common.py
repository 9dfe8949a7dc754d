"""Pieces shared by the operators: staged tables, global positions, raw bytes.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``; the six separators are the
characters that ``bytes.split()`` and ``bytes.strip()`` cut at.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

# Rows without an id count as documents with the smallest of all ids.
NO_ID = -(2**63)

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; the
    driver and all executors see it. There is no local fallback."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage and fixes the rows: a task repeated after a lost
    executor reads the same files. The folder's owner clears it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the write's shuffles go once it is done
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def positions(
    df: DataFrame, order_by: list[Column], name: str, sum_of: dict[str, str] | None = None
) -> DataFrame:
    """``df`` staged with ``_pos``, its 0-based place in ``order_by``.

    Rows are dealt by ranges of the order, sorted and tagged with the range's
    number and their place in it; the staged table fixes the tags. Ranges
    take their offsets from one row per range. ``sum_of`` {new: column} adds
    the column's sum over all rows before.
    """
    low = 33
    tagged = staged(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_tag", F.monotonically_increasing_id()),
        name,
    ).withColumn("_range", F.shiftright("_tag", low))
    sums = sum_of or {}
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_s_{new}") for new, c in sums.items())
    )
    offsets = offsets.select(  # one row per range
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *(F.coalesce(F.sum(f"_s_{new}").over(before), F.lit(0)).alias(f"_b_{new}") for new in sums),
    )
    inside = (
        Window.partitionBy("_range").orderBy("_tag").rowsBetween(Window.unboundedPreceding, -1)
    )
    out = tagged.join(F.broadcast(offsets), "_range").withColumn(
        "_pos", F.col("_before") + F.col("_tag").bitwiseAND((1 << low) - 1)
    )
    for new, c in sums.items():
        own = F.coalesce(F.sum(c).over(inside), F.lit(0))
        out = out.withColumn(new, F.col(f"_b_{new}") + own)
    return out.drop("_tag", "_range", "_before", *(f"_b_{new}" for new in sums))


def carried(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, _row): the whole row packed, so that no column of the
    input can clash with a column that an operator adds."""
    return docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.col(text_col).cast("string").alias("_text"),
        F.struct("*").alias("_row"),
    )


KEY = ["_key_a", "_key_b"]


def row_key(df: DataFrame) -> list[Column]:
    """128 bits that stand for a row's content, as ``KEY``: decisions made on a
    few columns find their rows again by it. Rows with one key are alike."""
    every = [F.col(f"`{c}`") for c in df.columns]
    return [F.xxhash64(F.lit(i), *every).alias(k) for i, k in enumerate(KEY)]


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches, rows: int = 256):
    """The record batches a few rows at a time: a batch may hold many long texts,
    and what a task turns into Python objects at once should not grow with it."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
