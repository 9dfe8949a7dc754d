"""The catalog's reader over CSV files written from the marketplace's reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.sources.catalog import Marketplace, read_csv_table, read_csv_with_rejects
from souk.sources.export import csv_line, shared_path, write_csv_lines, write_csv_table

TABLE = "order_reviews"


def _worded(m: Marketplace) -> DataFrame:
    """Reviews whose messages hold line breaks, quotes and delimiters."""
    k = F.col("review_id")
    said = F.concat(
        F.coalesce("review_comment_message", F.lit("")),
        F.lit('\n"'), k.cast("string"), F.lit('", he said,\r\n\nthen ""nothing'),
    )
    message = F.when(k % 3 == 0, said).when(k % 3 == 1, F.col("review_comment_message"))
    answered = F.timestamp_add("HOUR", (k % 1000).cast("int"), F.lit("2018-01-01 00:00:00").cast("timestamp_ntz"))
    return m.order_reviews.withColumns({"review_comment_message": message, "review_answer_timestamp": answered})


def reviews_through_csv(m: Marketplace) -> DataFrame:
    """The reviews written as CSV and read back, every file by many tasks."""
    rows = _worded(m)
    spark = rows.sparkSession
    path = shared_path(spark, "csv-reviews")
    write_csv_table(rows, path)
    return read_csv_table(spark, path, TABLE).select(
        "review_id", "order_id", "review_score", "review_comment_title", "review_comment_message",
        "review_answer_timestamp",
    )


def rejected_reviews(m: Marketplace) -> DataFrame:
    """(column, reason, raw) of the malformed values and records found in a CSV
    copy of the reviews with planted faults: scores and times that are none, and
    records with a field too many."""
    rows = _worded(m)
    k, spark = F.col("review_id"), rows.sparkSession
    as_text = rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns)).withColumns(
        {
            "review_score": F.when(k % 50 == 3, F.concat(F.lit("score "), k)).otherwise(F.col("review_score")),
            "review_creation_date": F.when(k % 70 == 6, F.concat(F.lit("day "), k)),
        }
    )
    record = csv_line(as_text)
    record = F.when(k % 90 == 4, F.concat(record, F.lit(",one more"))).otherwise(record)
    path = shared_path(spark, "csv-rejects")
    write_csv_lines(as_text.select(record.alias("value")), rows.columns, path)
    return read_csv_with_rejects(spark, path, TABLE)[1].select("column", "reason", "raw")
