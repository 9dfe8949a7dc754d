"""Bag of little bootstraps: the interval of a mean from small subsets.

A group's rows are dealt by a hash of their id; some buckets of the hash are subsets of
about ``subset_rows`` rows each, all other rows only count towards the group's mean and
size. Inside a subset every replicate draws multinomial weights that sum to the *whole*
group's size n, so its mean varies as a bootstrap mean of all n rows does; the
interval's ends are averaged over the subsets. The work of a row does not grow with the
replicates (the full bootstrap draws one weight for each), and a task holds one subset.
A subset's rows are its own, whatever the skew: a group with a third of all rows has as
many subsets, as large, as any other.

A group of fewer than two times ``subset_rows`` rows is one subset: the ordinary bootstrap.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.plans.distributions import _present
from souk.plans.skew import salted_join

SUBSETS, SUBSET_ROWS = 20, 4_000
_BITS = 52  # of the hash: exact as a double
_CELLS = 4_000_000  # weights held at once


def little_bootstrap_mean_ci(
    df: DataFrame,
    group_cols: list[str],
    value: str,
    id_col: str,
    replicates: int = 1000,
    level: float = 0.95,
    seed: int = 0,
    subsets: int = SUBSETS,
    subset_rows: int = SUBSET_ROWS,
) -> DataFrame:
    """(group columns, mean, n, n_subsets, ci_low, ci_high). Rows with a NULL value are left
    out, a NULL group is a group; a group of one row has its value at both ends. Ids should
    differ: rows that share one fall into one subset. Depends on ids, values and ``seed`` only."""
    lo, hi = (1 - level) / 2, (1 + level) / 2
    vals = _present(df, group_cols, value, [id_col]).select(
        *group_cols, F.col(value).cast("double").alias("_v"), F.col(id_col).cast("string").alias("_id")
    )
    stats = vals.groupBy(*group_cols).agg(F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("n"))
    stats = stats.withColumn(
        "n_subsets", F.greatest(F.lit(1), F.least(F.lit(subsets), F.floor(F.col("n") / subset_rows))).cast("int")
    )
    # one text per group, so that a NULL group joins too
    group_of = F.to_json(F.struct(*group_cols))
    tagged = stats.withColumn("_g", group_of)
    # the share of the hash that a subset takes; a single subset is the group
    share = F.when(F.col("n_subsets") == 1, 1.0).otherwise(F.lit(float(subset_rows)) / F.col("n"))
    place = F.shiftrightunsigned(F.xxhash64("_id", F.lit(seed)), 64 - _BITS) / F.lit(float(2**_BITS))
    drawn = (
        salted_join(
            vals.select(group_of.alias("_g"), "_v", "_id"),
            tagged.select("_g", "n", "n_subsets", share.alias("_share")),
            ["_g"],
            spread_by=["_id"],
        )
        .withColumn("_subset", F.floor(place / F.col("_share")).cast("int"))
        .filter("_subset < n_subsets")
        .select("_g", "_subset", "n", "_v", "_id")
    )

    def interval(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_id", "_v"], na_position="first")
        group, subset = part["_g"].iloc[0], int(part["_subset"].iloc[0])
        x, n = part["_v"].to_numpy(), int(part["n"].iloc[0])
        rng = np.random.default_rng([seed, subset, zlib.crc32(group.encode())])
        at_once = max(1, _CELLS // len(x))
        means = np.concatenate([
            rng.multinomial(n, np.full(len(x), 1 / len(x)), size=min(at_once, replicates - k)) @ x / n
            for k in range(0, replicates, at_once)
        ])
        low, high = np.quantile(means, [lo, hi])
        return pd.DataFrame({"_g": [group], "_subset": [subset], "_lo": [low], "_hi": [high]})

    ends = (
        drawn.groupBy("_g", "_subset")
        .applyInPandas(interval, "_g string, _subset int, _lo double, _hi double")
        .groupBy("_g")
        .agg(F.avg("_lo").alias("ci_low"), F.avg("_hi").alias("ci_high"))
    )
    return tagged.join(ends, "_g", "left").drop("_g")
