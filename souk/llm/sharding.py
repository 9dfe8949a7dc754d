"""Minimax contiguous partition of ordered atomic groups into shards.

Groups are equal texts, ordered by their smallest id (null ids first); a
group is never divided. A capacity is feasible if greedy filling in order
(each shard takes groups while it stays within the capacity) needs no more
than the given number of shards. The smallest feasible capacity is found by
a search over the integers: the prefix sums of the group sizes are a staged
table, and a greedy step for a capacity is "the largest prefix sum not above
the shard's start plus the capacity". Each job takes that step for several
capacities at once, so a round cuts the interval by their number plus one.
The interval starts between max(largest group, total / shards) and
total / shards + largest group, which is always feasible. The driver holds a
few numbers per capacity.

Only DataFrame functions; texts are read once and never shuffled.

Law ``bytes``: shard loads are near equal (as far as whole groups allow).

Defined results: a null text is the empty text (size 1, CRC 0, in the group
of empty texts); repeated rows are rows of one group, each with a slot; an
empty table gives an empty result. Rows of one group take slots by id, ties
in any order (such rows are alike).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import positions, sha256_of, staged

SHARDS = 8
# Capacities tried by one job.
TRIALS = 31


def _greedy(prefix: DataFrame, capacities: list[int], shards: int, largest: int) -> list[list[int]]:
    """For each capacity, the prefix sums at which the shards end."""
    ends = [[0] for _ in capacities]
    for _ in range(shards):
        reach = [e[-1] + c for e, c in zip(ends, capacities)]
        near = prefix.filter(F.col("upto").between(min(reach) - largest, max(reach)))
        found = near.agg(
            *(F.max(F.when(F.col("upto") <= x, F.col("upto"))).alias(f"c{i}") for i, x in enumerate(reach))
        ).first()
        for i, e in enumerate(ends):
            e.append(max(e[-1], found[i] or 0))
    return ends


def smallest_capacity(
    prefix: DataFrame, total: int, largest: int, shards: int, trials: int = TRIALS
) -> tuple[int, list[int]]:
    """The smallest feasible capacity and where its shards end; ``prefix`` has
    the running sums ``upto`` of the ordered groups."""
    low = max(largest, -(-total // shards))
    high = -(-total // shards) + largest
    best = None
    while best is None or low < high:
        width = high - low
        steps = sorted({low + width * i // (trials + 1) for i in range(trials + 1)} | {high})
        if best is not None:
            steps = [x for x in steps if x < high]
        ends = _greedy(prefix, steps, shards, largest)
        feasible = [(c, e) for c, e in zip(steps, ends) if e[-1] >= total]
        infeasible = [c for c, e in zip(steps, ends) if e[-1] < total]
        if feasible:
            high, best = feasible[0][0], feasible[0]
        low = min(high, max([low, *(c + 1 for c in infeasible if c < high)]))
    return best


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    rows_per_piece: int | None = None,
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row; the
    rows of one group are numbered ``rows_per_piece`` at a time, by default a
    quarter of a partition's share of all rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = staged(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            sha256_of(text).alias("_text"),
        ),
        "shard-rows",
    )
    if rows_per_piece is None:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows_per_piece = rows.count() // (4 * parts) + 1
    groups = rows.groupBy("_text").agg(
        F.min("_id").alias("_first"), F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")
    )
    placed = positions(
        groups, [F.col("_first").asc_nulls_first(), F.col("_text").asc()], "shard-groups",
        {"_from": "_bytes", "_row": "_rows"},
    )
    placed = staged(placed.withColumn("upto", F.col("_from") + F.col("_bytes")), "shard-prefix")
    sizes = placed.agg(F.max("upto"), F.max("_bytes")).first()
    ends = [0]
    if sizes[0] is not None:
        ends = smallest_capacity(placed.select("upto"), sizes[0], sizes[1], shards)[1]
    inner = ends[1:shards]
    number = sum((F.when(F.col("_from") >= e, 1).otherwise(0) for e in inner), F.lit(0))
    placed = placed.select("_text", "_rows", "_row", number.cast("int").alias("shard"))
    bases = placed.groupBy("shard").agg(F.min("_row").alias("_base"))  # one row per shard
    placed = placed.join(F.broadcast(bases), "shard").withColumn("_row", F.col("_row") - F.col("_base"))

    # places within a group: pieces by a hash of the id, numbered apart
    joined = rows.join(placed, "_text")
    pieces = F.ceil(F.col("_rows") / F.lit(rows_per_piece))
    joined = joined.withColumn("_piece", F.pmod(F.xxhash64("_id"), pieces))
    joined = joined.repartition("_text", "_piece")  # else the window stays with the join's tasks
    counts = joined.filter(F.col("_rows") > rows_per_piece).groupBy("_text", "_piece").agg(
        F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy("_text").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_text", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_text", "_piece").orderBy("_id")
    counts = counts.withColumnRenamed("_text", "_group").withColumnRenamed("_piece", "_part")
    numbered = joined.withColumn("_in", F.row_number().over(within) - 1)
    numbered = numbered.join(
        counts,
        (numbered["_text"] == counts["_group"]) & (numbered["_piece"] == counts["_part"]),
        "left",
    )
    return numbered.select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_row") + F.coalesce("_before", F.lit(0)) + F.col("_in")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
