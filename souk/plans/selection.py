"""Exact order statistics without a sort.

The value at a rank is found by narrowing an interval around it. A round cuts
the interval of each wanted rank into equal bins, counts the values in every
bin (a partial aggregate: a task leaves one row per bin, whatever its rows)
and keeps the bin that holds the rank; the interval then runs from that bin's
least value to its largest. Bins are a monotone function of the value, so
counts below a bin are counts of smaller values; both ends of an interval are
values, so every round leaves fewer distinct ones, and values spread over a
range leave it by a factor of ``bins``.

Rounds end when an interval is one value, or when all intervals together hold
at most ``last_rows`` rows: those are numbered by a window. What is still open
after ``most_rounds`` rounds, or has no finite width (infinite values, NaN),
is ordered by ranges (``plans.ranking``), those rows only.

A small input (no more rows than ``last_rows``) is a window from the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.plans.ranking import grouped_positions
from souk.plans.skew import salted_join
from souk.session import ensure_checkpoint_dir
from souk.sources.export import shared_path

BINS = 4096
LAST_ROWS = 200_000
MOST_ROUNDS = 8
# A table of one row per group joins by broadcast up to this many rows.
BROADCAST_ROWS = 10_000


def fixed(df: DataFrame) -> DataFrame:
    """``df`` written once (a reliable checkpoint), for several readers."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _written(df: DataFrame) -> DataFrame:
    """A small ``df`` as files: unlike a checkpoint's, its estimated size is its
    own and not that of the joins it came from, round after round."""
    path = shared_path(df.sparkSession, "selection")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(rows: DataFrame, per_group: DataFrame, group_cols: list[str], spread_by: list[str], n: int) -> DataFrame:
    """``rows`` joined to their group's rows in ``per_group``, of which there are
    ``n``: broadcast if those are few, else with large groups split."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(per_group), group_cols)
    return salted_join(rows, per_group, group_cols, spread_by=spread_by)


def _inside(vals: DataFrame, intervals: DataFrame, group_cols: list[str], value: str, n: int) -> DataFrame:
    x = F.col(value)
    # NaN is above all values, as in a sort
    return beside(vals, intervals, group_cols, [value], n).filter((x >= F.col("_lo")) & (x <= F.col("_hi")))


def _round(vals: DataFrame, targets: DataFrame, group_cols: list[str], value: str, bins: int, n: int) -> DataFrame:
    """The open targets with their intervals narrowed to one bin."""
    intervals = targets.select(*group_cols, "_lo", "_hi", "_below").distinct()
    part = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    counts = (
        _inside(vals, intervals, group_cols, value, n)
        .withColumn("_bin", F.least(F.floor(part * bins), F.lit(bins - 1)))
        .groupBy(*group_cols, "_lo", "_below", "_bin")
        .agg(F.count(F.lit(1)).alias("_c"), F.min(value).alias("_least"), F.max(value).alias("_most"))
    )
    up_to = Window.partitionBy(*group_cols, "_lo").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.col("_below") + F.coalesce(F.sum("_c").over(up_to), F.lit(0)))
    found = targets.select(*group_cols, "_rank", "_lo").join(counts.drop("_below"), [*group_cols, "_lo"])
    return found.filter(
        (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_c"))
    ).select(
        *group_cols, "_rank", F.col("_before").alias("_below"),
        F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), F.col("_c").alias("_n"),
    )


def order_statistics(
    vals: DataFrame,
    group_cols: list[str],
    value: str,
    ranks: DataFrame,
    bins: int = BINS,
    last_rows: int = LAST_ROWS,
    most_rounds: int = MOST_ROUNDS,
) -> DataFrame:
    """(group..., _rank, value) for the 0-based ``_rank``s wanted of each group.

    ``vals`` is read in every round: pass it written (``fixed``). Groups and
    values are without NULLs. ``ranks`` has a row per (group, _rank) below the
    group's size, beside the group's size, least and largest value (``_n``,
    ``_lo``, ``_hi``).
    """
    targets = _written(
        ranks.select(*group_cols, "_rank", F.lit(0).cast("long").alias("_below"), "_lo", "_hi", "_n")
    )
    done, width = [], F.col("_hi") - F.col("_lo")
    narrow = ~F.isnan(width) & (F.abs(width) < float("inf"))
    for left in range(most_rounds, -1, -1):
        done.append(targets.filter("_lo = _hi").select(*group_cols, "_rank", F.col("_lo").alias(value)))
        targets = targets.filter("not (_lo <=> _hi)")
        distinct = targets.select(*group_cols, "_lo", "_hi", "_n", narrow.alias("ok")).distinct()
        state = distinct.agg(
            F.count(F.lit(1)).alias("intervals"), F.sum("_n").alias("rows"), F.min("ok").alias("ok")
        ).first()
        if not state["intervals"]:
            break
        small = state["rows"] <= last_rows
        if small or not left or not state["ok"]:
            done.append(_numbered(vals, targets, group_cols, value, small, state["intervals"]))
            break
        targets = _written(_round(vals, targets, group_cols, value, bins, state["intervals"]))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _numbered(vals, targets, group_cols, value, small: bool, n: int) -> DataFrame:
    intervals = targets.select(*group_cols, "_lo", "_hi", "_below").distinct()
    rows = _inside(vals.select(*group_cols, value), intervals, group_cols, value, n)
    if small:  # few rows in all
        order = Window.partitionBy(*group_cols, "_lo").orderBy(value)
        rows = rows.withColumn("_at", F.col("_below") + F.row_number().over(order) - 1)
    else:
        keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
        rows = grouped_positions(keyed, [*group_cols, "_lo"], [F.col(value).asc(), F.col("_tie").asc()], "_place")
        rows = rows.withColumn("_at", F.col("_below") + F.col("_place") - 1)
    wanted = targets.select(*group_cols, F.col("_rank").alias("_at"))
    return rows.join(wanted, [*group_cols, "_at"]).select(
        *group_cols, F.col("_at").alias("_rank"), value
    )


def group_stats(vals: DataFrame, group_cols: list[str], value: str) -> DataFrame:
    """(group..., _n, _lo, _hi): size, least and largest value."""
    return vals.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
