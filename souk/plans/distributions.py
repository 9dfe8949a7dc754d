"""Distribution summaries per group: exact quantiles, box statistics,
Gaussian KDE on a grid and a bootstrap confidence interval of a mean.

None of them gathers a group into one task: quantiles are selected by counting
value ranges, the KDE sums per distinct value against a
small grid, the bootstrap aggregates weighted replicates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.expr import sqrt2pi
from souk.plans.selection import LAST_ROWS, beside, fixed, group_stats, order_statistics
from souk.plans.skew import hot_key_rows, salted_join


def _present(df: DataFrame, group_cols: list[str], value: str, extra: list[str]) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).select(*group_cols, value, *extra)


def _written(df: DataFrame, group_cols: list[str], value: str, extra: list[str]) -> DataFrame:
    return fixed(_present(df, group_cols, value, extra).dropna(how="any", subset=group_cols))


def grouped_quantiles(
    df: DataFrame,
    group_cols: list[str],
    value: str,
    probs: dict[str, float],
    last_rows: int = LAST_ROWS,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per name in
    ``probs``: at h = (n - 1) * p, x[floor h] + (x[ceil h] - x[floor h]) *
    (h - floor h) over the sorted non-NULL values of each group (rows without a
    group are dropped).

    The order statistics are selected by narrowing value ranges
    (``plans.selection``): nothing is sorted or gathered per group.
    """
    return _quantiles(_written(df, group_cols, value, []), group_cols, value, probs, last_rows)


def _quantiles(
    vals: DataFrame, group_cols: list[str], value: str, probs: dict[str, float], last_rows: int
) -> DataFrame:
    h = {q: (F.col("_n") - 1) * F.lit(float(p)) for q, p in probs.items()}
    ends = [f(x) for x in h.values() for f in (F.floor, F.ceil)]
    stats = fixed(group_stats(vals, group_cols, value))  # one row per group
    ranks = stats.select(*group_cols, "_n", "_lo", "_hi", F.explode(F.array_distinct(F.array(*ends))).alias("_rank"))
    found = order_statistics(vals, group_cols, value, ranks, last_rows=last_rows)
    at = found.groupBy(*group_cols).agg(F.map_from_entries(F.collect_list(F.struct("_rank", value))).alias("_at"))

    def quantile(x: Column) -> Column:
        low, high = F.col("_at")[F.floor(x)], F.col("_at")[F.ceil(x)]
        return low + (high - low) * (x - F.floor(x))

    return stats.join(at, group_cols).select(*group_cols, *(quantile(x).alias(q) for q, x in h.items()))


def _with_limits(
    df: DataFrame, group_cols: list[str], value: str, extra: list[str], whis: float, last_rows: int
) -> DataFrame:
    """Present values beside their group's quartiles and whisker limits."""
    vals = _written(df, group_cols, value, extra)
    quart = _quantiles(vals, group_cols, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, last_rows)
    iqr = F.col("q3") - F.col("q1")
    limits = fixed(
        quart.withColumns({"_lo_lim": F.col("q1") - whis * iqr, "_hi_lim": F.col("q3") + whis * iqr})
    )
    return beside(vals, limits, group_cols, [value, *extra], limits.count())


def box_fliers(
    df: DataFrame, group_cols: list[str], value: str, extra: list[str], whis: float = 1.5,
    last_rows: int = LAST_ROWS,
) -> DataFrame:
    """The rows (group, extra columns, value) outside the whiskers."""
    x = F.col(value)
    return (
        _with_limits(df, group_cols, value, extra, whis, last_rows)
        .filter((x < F.col("_lo_lim")) | (x > F.col("_hi_lim")))
        .select(*group_cols, *extra, value)
    )


def box_stats(
    df: DataFrame, group_cols: list[str], value: str, whis: float = 1.5, last_rows: int = LAST_ROWS
) -> DataFrame:
    """Box-plot statistics per group: n, q1, median, q3, whiskers (furthest
    data within ``whis`` * IQR of the box, the quartile if none) and the
    number of points outside the whiskers."""
    x = F.col(value)
    agg = (
        _with_limits(df, group_cols, value, [], whis, last_rows)
        .groupBy(*group_cols, "q1", "median", "q3")
        .agg(
            F.count(x).alias("n"),
            F.min(F.when(x >= F.col("_lo_lim"), x)).alias("_wlo"),
            F.max(F.when(x <= F.col("_hi_lim"), x)).alias("_whi"),
            # no data lies between a limit and its whisker, so counting
            # beyond the limit counts beyond the whisker
            F.count_if((x < F.col("_lo_lim")) | (x > F.col("_hi_lim"))).alias("n_fliers"),
        )
    )
    return agg.select(
        *group_cols, "n", "q1", "median", "q3",
        F.when(F.col("_wlo").isNull() | (F.col("_wlo") > F.col("q1")), F.col("q1"))
        .otherwise(F.col("_wlo")).alias("whislo"),
        F.when(F.col("_whi").isNull() | (F.col("_whi") < F.col("q3")), F.col("q3"))
        .otherwise(F.col("_whi")).alias("whishi"),
        "n_fliers",
    )


def kde(
    df: DataFrame,
    group_cols: list[str],
    value: str,
    gridsize: int = 200,
    cut: float = 3.0,
) -> DataFrame:
    """Gaussian kernel density of ``value`` per group on an evenly spaced
    grid of ``gridsize`` points from min - cut*bw to max + cut*bw.

    Bandwidth: Scott's rule, n^(-1/5) * sample standard deviation. Each
    group is normalised on its own. Groups with fewer than two distinct
    values (zero spread) have no density and are left out.

    Plan: values are pre-aggregated to (group, value, count); the grid
    (gridsize rows per group) is small and joined to them, and the
    gridsize x distinct-values terms are summed per grid point right after
    the join (partial aggregation), never shuffled as such.
    """
    vals = _present(df, group_cols, value, [])
    counts = vals.groupBy(*group_cols, value).agg(F.count(F.lit(1)).alias("_c"))
    return _on_grid(counts, _spread(vals, group_cols, value, cut), group_cols, value, gridsize)


def kde_binned(
    df: DataFrame,
    group_cols: list[str],
    value: str,
    gridsize: int = 200,
    cut: float = 3.0,
    tolerance: float = 1e-4,
) -> DataFrame:
    """``kde`` from binned values, for groups of very many distinct values.

    Each value is shared out between the two nodes beside it on a fine even
    grid, in proportion to its nearness, so a group leaves at most one row per
    node, however many values it has; the kernel is summed over the nodes.

    Error: sharing out replaces the kernel between two nodes by a chord, which
    is off by at most delta^2 / 8 times its largest second derivative,
    1 / (bw^3 sqrt(2 pi)), for nodes delta apart. A density over a range R peaks
    at 1 / R at least, so with delta^2 = 8 sqrt(2 pi) tolerance bw^3 / R the error
    is below ``tolerance`` times the peak. A group has (R / bw)^1.5 /
    sqrt(8 sqrt(2 pi) tolerance) nodes (22 300 for R = 100 bw), and at most two
    for each distinct value.
    """
    vals = _present(df, group_cols, value, [])
    stats = fixed(_spread(vals, group_cols, value, cut))  # one row per group
    bw, reach = F.col("_bw"), F.col("_stop") - F.col("_start")
    delta = F.sqrt(F.lit(8.0) * sqrt2pi() * F.lit(tolerance) * bw * bw * bw / reach)
    edges = stats.select(*group_cols, "_start", delta.alias("_delta"))
    at = (F.col(value) - F.col("_start")) / F.col("_delta")
    shares = F.array(
        F.struct(F.col("_j"), (1 - (F.col("_at") - F.col("_j"))).alias("_w")),
        F.struct((F.col("_j") + 1).alias("_j"), (F.col("_at") - F.col("_j")).alias("_w")),
    )
    nodes = (
        beside(vals, edges, group_cols, [value], stats.count())
        .withColumn("_at", at)
        .withColumn("_j", F.floor("_at"))
        .select(*group_cols, "_start", "_delta", F.explode(shares).alias("_s"))
        .groupBy(*group_cols, "_start", "_delta", "_s._j")
        .agg(F.sum("_s._w").alias("_c"))
        .select(*group_cols, (F.col("_start") + F.col("_j") * F.col("_delta")).alias(value), "_c")
    )
    return _on_grid(nodes, stats, group_cols, value, gridsize)


def _spread(vals: DataFrame, group_cols: list[str], value: str, cut: float) -> DataFrame:
    """Per group with spread: size, bandwidth and the ends of its grid."""
    bw = F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2))
    return (
        vals.groupBy(*group_cols)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.stddev_samp(value).alias("_sd"),
            F.min(value).alias("_min"),
            F.max(value).alias("_max"),
        )
        .withColumn("_bw", bw)
        .filter(F.col("_bw") > 0)
        .withColumns(
            {
                "_start": F.col("_min") - cut * F.col("_bw"),
                "_stop": F.col("_max") + cut * F.col("_bw"),
            }
        )
    )


def _on_grid(counts: DataFrame, stats: DataFrame, group_cols: list[str], value: str, gridsize: int) -> DataFrame:
    """The kernel sums of weighted values (``_c``) on each group's grid."""
    step = (F.col("_stop") - F.col("_start")) / (gridsize - 1)
    j = F.col("point")
    grid = stats.select(
        *group_cols, "_n", "_bw", "_start", "_stop",
        F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("point"),
    ).withColumn(
        "x", F.when(j == gridsize - 1, F.col("_stop")).otherwise(j * step + F.col("_start"))
    )
    z = (F.col("x") - F.col(value)) / F.col("_bw")
    # a group with very many distinct values is split; its grid is copied
    return (
        salted_join(
            counts, grid, group_cols, spread_by=[value],
            rows_per_piece=max(1, hot_key_rows(counts) // gridsize),  # a row meets the whole grid
        )
        .groupBy(*group_cols, "point", "x", "_n", "_bw")
        .agg(F.sum(F.col("_c") * F.exp(-0.5 * z * z)).alias("_k"))
        .select(
            *group_cols, "point", "x",
            (F.col("_k") / (F.col("_n") * F.col("_bw") * sqrt2pi())).alias("density"),
        )
    )


# A replicate's weight is drawn from 8 hex digits of an md5, which holds 4.
_DRAWS_PER_HASH, _DRAW_DIGITS = 4, 8


def poisson1_thresholds() -> list[int]:
    """32-bit draws from which a Poisson(1) weight is above 0, 1, 2, ...:
    P(K <= k) * 2^32, as far as a draw can reach."""
    out, acc, term, k = [], 0.0, math.exp(-1.0), 0
    while math.ceil((acc := acc + term) * 2**32) < 2**32:
        out.append(math.ceil(acc * 2**32))
        k += 1
        term /= k
    return out


def bootstrap_mean_ci(
    df: DataFrame,
    group_cols: list[str],
    value: str,
    id_col: str,
    replicates: int = 1000,
    level: float = 0.95,
    seed: int = 0,
) -> DataFrame:
    """Mean of ``value`` per group with a percentile bootstrap interval.

    Poisson(1) bootstrap: in replicate b every row gets an independent
    Poisson(1) weight drawn from the md5 of (id, b div 4, seed), so replicates
    are reproducible, in any engine, and need no resampling shuffle; each
    replicate mean is a weighted mean (a partial aggregate per (group, b)). The
    interval takes the (1 - level)/2 and (1 + level)/2 percentiles of the
    ``replicates`` means of a group (a bounded set per group).
    """
    vals = _present(df, group_cols, value, [id_col])
    hashes = math.ceil(replicates / _DRAWS_PER_HASH)
    text = F.concat_ws(":", F.col(id_col).cast("string"), F.col("_h").cast("string"), F.lit(str(seed)))
    digits = F.substr("_md5", F.col("_d") * _DRAW_DIGITS + 1, F.lit(_DRAW_DIGITS))
    draw = F.conv(digits, 16, 10).cast("long")
    weight = sum((F.col("_u") >= F.lit(t)).cast("int") for t in poisson1_thresholds())
    reps = (
        vals.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))))
        .withColumn("_md5", F.md5(text.cast("binary")))
        .withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(_DRAWS_PER_HASH - 1))))
        .withColumns({"_b": F.col("_h") * _DRAWS_PER_HASH + F.col("_d"), "_u": draw})
        .filter(F.col("_b") < replicates)
        .withColumn("_w", weight)
        .groupBy(*group_cols, "_b")
        .agg(
            F.try_divide(F.sum(F.col("_w") * F.col(value)), F.sum("_w")).alias("_m")
        )
    )
    lo, hi = (1 - level) / 2, (1 + level) / 2
    ci = reps.groupBy(*group_cols).agg(
        F.percentile("_m", F.lit(lo)).alias("ci_low"),
        F.percentile("_m", F.lit(hi)).alias("ci_high"),
    )
    means = vals.groupBy(*group_cols).agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")
    )
    return means.join(ci, group_cols, "left")
