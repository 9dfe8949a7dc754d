"""Global positions and running sums without a single-partition window.

``Window.orderBy(...)`` with no partitioning moves every row to one task.
Here rows are range-partitioned on the sort key, sorted inside each
partition and tagged with ``monotonically_increasing_id`` (partition index
in the high bits, row index in the low 33 bits). A reliable checkpoint
fixes those tags: a recomputed partition after an executor loss, or a
second evaluation, cannot draw different range bounds. Per-partition
counts and sums (one row per partition, so their size is bounded by the
partition count) give each partition its offset.

The sort key should be a total order (end it with a unique column): the
range partitioner then splits even a heavily tied value over many
partitions, and positions are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.plans.skew import salted_join
from souk.session import ensure_checkpoint_dir

_ROW, _PART, _BEFORE_N, _BEFORE_S, _IN_PART = "_row", "_part", "_before_n", "_before_s", "_in_part"
_LOW_BITS = 33


def ordered(
    df: DataFrame,
    order_by: list[Column],
    position: str = "position",
    running_of: str | None = None,
    running: str = "running_before",
) -> DataFrame:
    """``df`` with a 1-based ``position`` in the order ``order_by``.

    With ``running_of``, also ``running``: the sum of that column over all
    rows strictly before (NULL counted as 0; 0 for the first row).
    """
    ensure_checkpoint_dir(df.sparkSession)
    # no explicit partition count: AQE may merge neighbouring ranges of a
    # small input (merged ranges stay in order)
    staged = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn(_ROW, F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    part = F.shiftright(F.col(_ROW), _LOW_BITS)
    in_part = F.col(_ROW).bitwiseAND((1 << _LOW_BITS) - 1)
    value = F.coalesce(F.col(running_of), F.lit(0)) if running_of else None

    aggs = [F.count(F.lit(1)).alias("_n")]
    if value is not None:
        aggs.append(F.sum(value).alias("_s"))
    per_part = staged.groupBy(part.alias(_PART)).agg(*aggs)
    # One row per partition: ordering it on one task is fine.
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        _PART,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(_BEFORE_N),
        *(
            [F.coalesce(F.sum("_s").over(before), F.lit(0)).alias(_BEFORE_S)]
            if value is not None
            else []
        ),
    )
    out = staged.withColumn(_PART, part).join(F.broadcast(offsets), _PART)
    out = out.withColumn(position, F.col(_BEFORE_N) + in_part + 1)
    if value is not None:
        inside = (
            Window.partitionBy(_PART)
            .orderBy(_ROW)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        out = out.withColumn(
            running, F.col(_BEFORE_S) + F.coalesce(F.sum(value).over(inside), F.lit(0))
        )
    return out.drop(_ROW, _PART, _BEFORE_N, _BEFORE_S)


def grouped_positions(
    df: DataFrame, group_cols: list[str], order_by: list[Column], position: str = "position"
) -> DataFrame:
    """1-based position inside each group, plus the group size ``group_n``.

    Rows are ordered globally by (group, order) and each group's first
    global position is subtracted; the per-group table is an aggregate
    joined back on the group key. Rows with a NULL group key are dropped
    (as a group-by on a data frame does).
    """
    keyed = df.dropna(how="any", subset=group_cols)
    glob = ordered(keyed, [*(F.col(c).asc() for c in group_cols), *order_by], "_gpos")
    starts = glob.groupBy(*group_cols).agg(
        F.min("_gpos").alias("_start"), F.count(F.lit(1)).alias("group_n")
    )
    # one group may hold most rows: its rows are split over several tasks
    return (
        salted_join(glob, starts, group_cols, "left", spread_by=["_gpos"], other_unique=True)
        .withColumn(position, F.col("_gpos") - F.col("_start") + 1)
        .drop("_gpos", "_start")
    )
