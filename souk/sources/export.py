"""CSV files of marketplace tables, as ``souk.sources.catalog`` reads them."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.session import ensure_checkpoint_dir

_WRITE = {
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names in ``spark.checkpoint.dir``;
    the folder's owner clears it."""
    ensure_checkpoint_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_csv_table(df: DataFrame, path: str) -> None:
    """``df`` as CSV files with a header; quotes are doubled, line breaks quoted."""
    df.write.options(header=True, **_WRITE).csv(path)


def write_csv_lines(lines: DataFrame, header: list[str], path: str) -> None:
    """Ready records (one string column) as text files, each below ``header``."""
    first = ",".join(header)

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([first])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    lines.mapInArrow(run, "value string").write.text(path)


def csv_line(df: DataFrame) -> F.Column:
    """The record of a row of ``df`` as a column."""
    return F.to_csv(F.struct(*df.columns), _WRITE)
