"""Salted joins for keys that may hold a large share of all rows.

A sort-merge join sends every row of one key to one task. When one order,
seller or product holds a third of the rows, that task does a third of the
work. AQE can split such a partition only for a join standing alone in its
stage directly over two shuffles, which the marts' chained, aggregated
inputs are not; so the split is written out:

* hot keys are found from a deterministic 1-in-k sample (a hash of the row,
  so every evaluation finds the same keys), counted per key and scaled up;
  a key is hot above ``rows_per_piece`` rows;
* each row of a hot key on the big side goes to one of
  ceil(rows / rows_per_piece) pieces, chosen by a hash of the row;
* the other side's rows of a hot key are copied to every piece;
* the join runs on (key, piece); cold keys use piece 0 on both sides.

Keys of the base tables are looked up in a sketch: ``sketch`` counts the sampled
rows of all a table's key columns in one pass (counts of parts add up, and the
result is bounded as below), and every join of a query shares it
(``Marketplace.hot``). A join of rows that come from a base table by filters,
aggregates and lookups has no more rows of a key than that table, so the table's
sketch serves it too: pieces too many cost a copy, never a row. Without hot keys the
join is the plain one. Other inputs are sampled where they are joined.

A shuffle's number of partitions is a session setting, and AQE merges partitions by
their compressed bytes, so a task's rows of a join or an aggregate, and its memory,
grow with the tables. The sketch therefore also estimates the table's rows; where
those are more than one task should take, the looked-up side is dealt out by the
join's key over ``tasks_for(rows)`` partitions, which AQE leaves as they are, and
Spark deals out the big side the same way.

The hot-key table holds the keys with most rows, at most four for each
shuffle partition, so broadcasting it is bounded by the cluster's setting
and not by the data: a key beyond those holds less than a quarter of a
partition's share and needs no split. Results are exactly those of the
plain join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Session setting: rows of one key above which the key is split.
HOT_KEY_ROWS = "souk.skew.hotKeyRows"
DEFAULT_HOT_KEY_ROWS = 1_000_000
# About this many sampled rows stand for a key at the threshold.
_SAMPLED_AT_THRESHOLD = 100

# Session setting: rows that a task of a large join or aggregate takes.
ROWS_PER_TASK = "souk.skew.rowsPerTask"
DEFAULT_ROWS_PER_TASK = 400_000

_PIECES, _SALT = "_pieces", "_salt"
_TURNS, _TURN, _MET, _BIG = "_turns", "_turn", "_met", "_big"
# Keys beyond this many for each shuffle partition hold too little to split.
_HOT_KEYS_PER_PARTITION = 4
# Pieces for the rows without a key, more than any cluster has tasks at once.
_NULL_PIECES = 1 << 16


@dataclass(frozen=True)
class HotKeys:
    """The keys of one column that hold more than a piece's rows, with the
    number of pieces of each, and whether its NULLs do; about how many rows
    the table has."""

    kind: str
    pieces: tuple[tuple[object, int], ...] = ()
    nulls: bool = False
    rows: int = 0

    def table(self, spark, key: str) -> DataFrame:
        """(key, _pieces): a local table, at most four keys for each shuffle partition."""
        rows = [(str(k), n) for k, n in self.pieces]
        return spark.createDataFrame(rows, f"_k string, {_PIECES} int").select(
            F.col("_k").cast(self.kind).alias(key), _PIECES
        )


def sketch(
    df: DataFrame, columns: list[str], identity: list[str], rows_per_piece: int | None = None
) -> dict[str, HotKeys]:
    """The hot keys of each of the ``columns``, from one pass over ``df``: a
    deterministic sample of the rows, drawn by a hash of ``identity`` (columns
    that tell rows apart), counted per (column, key). The whole sample counts as
    one more key, for the number of rows."""
    limit = rows_per_piece or hot_key_rows(df)
    every = max(1, limit // _SAMPLED_AT_THRESHOLD)
    most = _HOT_KEYS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every_row = (-1, F.lit(None))
    marked = [every_row, *((i, F.col(c)) for i, c in enumerate(columns))]
    keys = F.array(*(F.struct(F.lit(i).alias("i"), c.cast("string").alias("k")) for i, c in marked))
    est = F.col("n") * every
    counted = (
        df.filter(F.pmod(_row_hash(identity, 17), F.lit(every)) == 0)
        .select(F.explode(keys).alias("key"))
        .groupBy("key.i", "key.k")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter((est > limit) | (F.col("i") < 0))
    )
    first = Window.partitionBy("i").orderBy(F.desc("n"), "k")  # keys over the threshold only
    found = counted.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= most + 1).collect()
    kinds = dict(df.dtypes)
    rows = sum(r["n"] * every for r in found if r["i"] < 0)
    return {
        c: HotKeys(
            kinds[c],
            tuple((r["k"], -(-r["n"] * every // limit)) for r in found if r["i"] == i and r["k"] is not None)[:most],
            any(r["i"] == i and r["k"] is None for r in found),
            rows,
        )
        for i, c in enumerate(columns)
    }


def hot_key_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_KEY_ROWS, str(DEFAULT_HOT_KEY_ROWS)))


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Partitions that share out ``rows`` rows, and no fewer than run at once; None
    where one task may take them all."""
    tasks = -(-rows // int(spark.conf.get(ROWS_PER_TASK, str(DEFAULT_ROWS_PER_TASK))))
    at_once = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(tasks, at_once) if tasks > 1 else None


def in_tasks(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` over ``tasks`` partitions (None: as it is)."""
    return df.repartition(tasks, *keys) if tasks else df


def _row_hash(cols: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *(F.col(c) for c in cols))


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def hot_keys(
    df: DataFrame, key: str | list[str], spread_by: list[str], rows_per_piece: int | None = None
) -> DataFrame:
    """(key..., _pieces) for the keys of ``df`` holding more than
    ``rows_per_piece`` rows, estimated from a deterministic sample.

    ``spread_by`` are columns that tell rows of one key apart; the sample
    and the pieces are drawn from their hash.
    """
    keys = _keys(key)
    limit = rows_per_piece or hot_key_rows(df)
    every = max(1, limit // _SAMPLED_AT_THRESHOLD)
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    sampled = df.filter(
        present & (F.pmod(_row_hash([*keys, *spread_by], 17), F.lit(every)) == 0)
    )
    est = F.col("_n") * every
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        sampled.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(est > limit)
        .orderBy(F.desc("_n"), *keys)
        .limit(_HOT_KEYS_PER_PARTITION * parts)
        .select(*keys, F.ceil(est / limit).cast("int").alias(_PIECES))
    )


def _each(pieces: str) -> Column:
    """One row for each piece of a hot key, one for any other key."""
    return F.explode(
        F.when(F.col(pieces).isNull(), F.array(F.lit(0))).otherwise(
            F.sequence(F.lit(0), F.col(pieces) - 1)
        )
    )


def salted_join(
    big: DataFrame,
    other: DataFrame,
    key: str | list[str],
    how: str = "inner",
    spread_by: list[str] | None = None,
    other_unique: bool = False,
    rows_per_piece: int | None = None,
    other_spread_by: list[str] | None = None,
    hot: HotKeys | None = None,
    other_hot: HotKeys | None = None,
    tasks: int | None = None,
    keep_salt: bool = False,
) -> DataFrame:
    """``big.join(other, key, how)`` with hot keys of ``big`` split.

    ``how`` is "inner", "left" or "left_anti" (``big`` is the preserved side), or
    "full" where both sides' hot keys are given.
    ``other_spread_by``: keys with many rows in ``other`` are split as well,
    by the hash of these columns of it (not for "left_anti").
    ``other_unique``: ``other`` has at most one row per key; the salted copy
    is then regrouped per (key, piece) so the optimizer still knows it is
    unique and can drop a left join whose columns are not used.
    ``hot``, ``other_hot``: the sides' hot keys, as sketched; else ``big`` (and
    ``other``, if split) is sampled here.
    ``tasks``: partitions of the join, from ``tasks_for``; else by the rows of ``hot``.
    ``keep_salt``: a split join's piece stays in the rows, which lie by (key, piece),
    for ``merged``.
    """
    keys = _keys(key)
    if tasks is None and hot is not None:
        tasks = tasks_for(big.sparkSession, hot.rows)
    spread = spread_by or [c for c in big.columns if c not in keys]
    if how == "full" and (hot is None or (other_spread_by and other_hot is None)):
        raise ValueError("a full join needs both sides' hot keys")
    if hot is not None:
        turned = bool(other_spread_by) and other_hot is not None and (
            bool(other_hot.pieces) or (how == "full" and other_hot.nulls)
        )
        if not hot.pieces and not hot.nulls and not turned:
            if not other_spread_by or other_hot is not None:
                return big.join(in_tasks(other, tasks, *keys), keys, how)
        pieces = F.broadcast(hot.table(big.sparkSession, keys[0]))
    else:
        pieces = F.broadcast(hot_keys(big, keys, spread, rows_per_piece))
    piece = F.pmod(_row_hash(spread, 29), F.col(_PIECES))
    # rows with a NULL key match nothing: any piece will do, so they spread
    no_key = reduce(or_, (F.col(k).isNull() for k in keys))
    anywhere = F.pmod(_row_hash(spread, 29), F.lit(_NULL_PIECES))
    salted_big = big.join(pieces, keys, "left").withColumn(
        _SALT, F.when(no_key, anywhere).otherwise(F.coalesce(piece, F.lit(0))).cast("int")
    ).drop(_PIECES)
    salted_other = other.join(pieces, keys, "left").withColumn(_SALT, _each(_PIECES))
    if how == "full" and other_spread_by:
        # kept rows without a key spread as well
        loose = F.pmod(_row_hash(other_spread_by, 31), F.lit(_NULL_PIECES)).cast("int")
        salted_other = salted_other.withColumn(_SALT, F.when(no_key, loose).otherwise(F.col(_SALT)))
    if how != "full":
        salted_other = salted_other.drop(_PIECES)
    if not other_spread_by:
        salted_other = in_tasks(salted_other, tasks, *keys, _SALT)
    if other_unique:
        values = [c for c in other.columns if c not in keys]
        salted_other = salted_other.groupBy(*keys, _SALT).agg(
            *(F.min(c).alias(c) for c in values)
        )
    if how == "full":
        return _full(salted_big, salted_other, keys, other_spread_by, other_hot, tasks)
    if not other_spread_by:
        joined = salted_big.join(salted_other, [*keys, _SALT], how)
        return joined if keep_salt else joined.drop(_SALT)
    if other_hot is not None:
        many = other_hot.table(big.sparkSession, keys[0])
    else:
        many = hot_keys(other, keys, other_spread_by, rows_per_piece)
    many = F.broadcast(many.withColumnRenamed(_PIECES, _TURNS))
    turn = F.pmod(_row_hash(other_spread_by, 31), F.col(_TURNS)).cast("int")
    salted_big = salted_big.join(many, keys, "left").withColumn(_TURN, _each(_TURNS))
    salted_other = (
        salted_other.join(many, keys, "left")
        .withColumns({_TURN: F.coalesce(turn, F.lit(0)), _MET: F.lit(True)})
        .drop(_TURNS)
    )
    salted_other = in_tasks(salted_other, tasks, *keys, _SALT, _TURN)
    # a key that is hot in ``other`` has rows there, so in a left join a copy
    # without a match only repeats a row that is matched elsewhere
    joined = salted_big.join(salted_other, [*keys, _SALT, _TURN], how)
    return joined.filter(F.col(_TURNS).isNull() | F.col(_MET).isNotNull()).drop(
        _SALT, _TURN, _TURNS, _MET
    )


def spread_sums(
    df: DataFrame, key: str, sums: list[Column], tasks: int | None, spread_by: list[str], hot: HotKeys
) -> DataFrame:
    """``df.groupBy(key).agg(*sums)`` (named sums and counts) over ``tasks``
    partitions; a hot key is summed in pieces first."""
    if not tasks:
        return df.groupBy(key).agg(*sums)
    if not hot.pieces:
        return in_tasks(df, tasks, key).groupBy(key).agg(*sums)
    piece = F.pmod(_row_hash(spread_by, 29), F.col(_PIECES))
    salted = df.join(F.broadcast(hot.table(df.sparkSession, key)), key, "left").withColumn(
        _SALT, F.coalesce(piece, F.lit(0)).cast("int")
    )
    return merged(in_tasks(salted, tasks, key, _SALT).groupBy(key, _SALT).agg(*sums), [key], tasks)


def pieces_of(rows: DataFrame) -> list[str]:
    """The column of a split join's pieces, if ``salted_join`` has kept it."""
    return [_SALT] if _SALT in rows.columns else []


def merged(
    parts: DataFrame, keys: list[str], tasks: int | None, least: tuple[str, ...] = (), most: tuple[str, ...] = ()
) -> DataFrame:
    """One row per ``keys`` from the aggregates of each piece: the smallest of the
    columns ``least``, the largest of ``most``, the sum of the others."""
    if not pieces_of(parts):
        return parts
    folds = dict.fromkeys(least, F.min) | dict.fromkeys(most, F.max)
    values = [f for f in parts.schema.fields if f.name not in (*keys, _SALT)]
    return in_tasks(parts, tasks, *keys).groupBy(*keys).agg(
        *(folds.get(f.name, F.sum)(f.name).cast(f.dataType).alias(f.name) for f in values)
    )


def _full(
    salted_big: DataFrame, salted_other: DataFrame, keys: list[str],
    other_spread_by: list[str] | None, other_hot: HotKeys | None, tasks: int | None,
) -> DataFrame:
    """The full join of the two salted sides. A key that is hot on one side has
    rows there, so a copy of the other side's row that meets none of them in
    its piece only repeats a row that is matched elsewhere; it goes."""
    salted_big = salted_big.withColumn(_BIG, F.lit(True))
    on = [*keys, _SALT]
    if other_spread_by and other_hot is not None and other_hot.pieces:
        many = F.broadcast(other_hot.table(salted_big.sparkSession, keys[0]).withColumnRenamed(_PIECES, _TURNS))
        salted_big = salted_big.join(many, keys, "left").withColumn(_TURN, _each(_TURNS))
        salted_other = salted_other.join(many.withColumnRenamed(_TURNS, "_own"), keys, "left").withColumn(
            _TURN, F.coalesce(F.pmod(_row_hash(other_spread_by, 31), F.col("_own")).cast("int"), F.lit(0))
        ).drop("_own")
        on.append(_TURN)
    else:
        salted_big = salted_big.withColumn(_TURNS, F.lit(None).cast("int"))
    salted_other = in_tasks(salted_other, tasks, *on)
    joined = salted_big.join(salted_other.withColumn(_MET, F.lit(True)), on, "full")
    both = F.col(_BIG).isNotNull() & F.col(_MET).isNotNull()
    lone_big = F.col(_MET).isNull() & F.col(_TURNS).isNull()
    lone_other = F.col(_BIG).isNull() & F.col(_PIECES).isNull()
    return joined.filter(both | lone_big | lone_other).drop(_SALT, _TURN, _TURNS, _MET, _BIG, _PIECES)
