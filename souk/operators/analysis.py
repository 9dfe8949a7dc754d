"""Per-segment distribution summaries behind the analysis charts, and the
significant-coefficient table of a linear model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.plans import leastsquares
from souk.plans.bags import little_bootstrap_mean_ci
from souk.plans.distributions import (
    bootstrap_mean_ci,
    box_fliers,
    box_stats,
    grouped_quantiles,
    kde,
    kde_binned,
)

# Fixed values of the charts: density grids of 200 points cut 3 bandwidths
# beyond the data, violins of 100 points cut 2 bandwidths beyond, whiskers
# at 1.5 IQR, 1000 bootstrap replicates for a 95 % interval, significance
# at p < 0.05.
KDE_GRID, KDE_CUT = 200, 3.0
VIOLIN_GRID, VIOLIN_CUT = 100, 2.0
WHISKERS = 1.5
BOOT_REPLICATES, BOOT_LEVEL = 1000, 0.95
P_VALUE = 0.05


def kde_by_dimension(
    df: DataFrame, variable: str, dimension: str,
    gridsize: int = KDE_GRID, cut: float = KDE_CUT,
) -> DataFrame:
    """Density of ``variable`` for each value of ``dimension``, each
    normalised on its own (rows with a NULL dimension are dropped)."""
    keyed = df.filter(F.col(dimension).isNotNull())
    return kde(keyed, [dimension], variable, gridsize, cut)


def kde_active_months(cohorts: DataFrame) -> DataFrame:
    """Density of active months per overlapping cohort."""
    return kde(cohorts, ["cohort"], "active_months", KDE_GRID, KDE_CUT)


def kde_wait_time(segments: DataFrame, binned: bool = False) -> DataFrame:
    """Density of customer wait per profile; ``binned`` within a ten-thousandth
    of its peak, at a cost that does not grow with the distinct waits."""
    density = kde_binned if binned else kde
    return density(segments.filter(F.col("profile").isNotNull()), ["profile"], "wait_time", KDE_GRID, KDE_CUT)


def box_wait_time(segments: DataFrame) -> DataFrame:
    """Box statistics of customer wait per profile."""
    return box_stats(segments, ["profile"], "wait_time", WHISKERS)


def fliers_wait_time(segments: DataFrame) -> DataFrame:
    """The sellers whose customer wait lies outside the whiskers of their profile."""
    return box_fliers(segments, ["profile"], "wait_time", ["seller_id"], WHISKERS)


def violin_sales_per_order(segments: DataFrame) -> DataFrame:
    """Violin data of sales per order per profile: density on a 100-point
    grid and the quartiles drawn inside. A profile whose values are all
    equal has no spread: it is drawn as one point of density 1."""
    value = "sales_per_order"
    dens = kde(segments, ["profile"], value, VIOLIN_GRID, VIOLIN_CUT)
    flat = (
        segments.filter(F.col(value).isNotNull() & F.col("profile").isNotNull())
        .groupBy("profile")
        .agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        .filter(F.col("_lo") == F.col("_hi"))
        .select("profile", F.lit(0).alias("point"), F.col("_lo").alias("x"),
                F.lit(1.0).alias("density"))
    )
    quart = grouped_quantiles(
        segments, ["profile"], value, {"q1": 0.25, "median": 0.5, "q3": 0.75}
    )
    return dens.unionByName(flat).join(quart, "profile", "left")


def mean_one_star(segments: DataFrame) -> DataFrame:
    """Mean share of one-star reviews per profile."""
    return segments.groupBy("profile").agg(
        F.avg("share_of_one_stars").alias("mean_share_of_one_stars"),
        F.count("share_of_one_stars").alias("n_sellers"),
    )


def mean_one_star_ci(segments: DataFrame, seed: int = 0) -> DataFrame:
    """Mean share of one-star reviews per profile with a 95 % bootstrap
    interval (reproducible for a given seed)."""
    return bootstrap_mean_ci(
        segments, ["profile"], "share_of_one_stars", "seller_id",
        BOOT_REPLICATES, BOOT_LEVEL, seed,
    )


def mean_wait_time_ci(orders: DataFrame, seed: int = 0) -> DataFrame:
    """Mean wait time of the orders of each review score with a 95 % interval by a
    bag of little bootstraps: for order-sized data, where a weight per row and
    replicate is too much."""
    return little_bootstrap_mean_ci(
        orders, ["review_score"], "wait_time", "order_id", BOOT_REPLICATES, BOOT_LEVEL, seed
    )


def significant_coefficients(coefs: DataFrame, alpha: float = P_VALUE) -> DataFrame:
    """Coefficients whose p-value is below ``alpha``, largest first.

    ``coefs`` holds (variable, coef, p_value) rows, e.g. from ``ols``.
    """
    return (
        coefs.filter(F.col("p_value") < alpha)
        .select("variable", "p_value", "coef")
        .orderBy(F.col("coef").desc(), F.col("variable"))
    )


# Midpoints of the t distribution's tail integral, and how far it is followed
# in units of the statistic (beyond 40 nothing is left at double precision
# unless the tail is bounded by the quarter turn first).
_TAIL_STEPS, _TAIL_REACH = 20_000, 40.0
# A pivot below this share of the feature's variance is a linear dependence.
_DEPENDENT = 1e-10


def _swept(matrix: Column, size: int) -> Column:
    """The ``size`` x ``size`` matrix (flat, by rows) swept on all but its last
    diagonal element. Dependent rows and columns become zero."""

    def at(m: Column, i: Column, j: Column) -> Column:
        return F.get(m, i * size + j)

    def sweep(m: Column, k: Column) -> Column:
        pivot = at(m, k, k)

        def cell(v: Column, x: Column) -> Column:
            i, j = F.floor(x / size).cast("int"), (x % size).cast("int")
            return (
                F.when(pivot > _DEPENDENT * at(matrix, k, k), F.when((i == k) & (j == k), 1 / pivot)
                       .when(i == k, v / pivot)
                       .when(j == k, -v / pivot)
                       .otherwise(v - at(m, i, k) * at(m, k, j) / pivot))
                .when((i == k) | (j == k), F.lit(0.0))
                .otherwise(v)
            )

        return F.transform(m, cell)

    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 2)), matrix, sweep)


def _two_sided_p(t: Column, dof: Column) -> Column:
    """P(|T| > t) of Student's t: with T = sqrt(dof) tan(a) the density is
    proportional to cos(a)^(dof - 1), summed at midpoints."""
    start = F.atan(t / F.sqrt(dof))
    stop = F.least(F.lit(math.pi / 2), _TAIL_REACH / F.sqrt(dof))

    def integral(lo: Column) -> Column:
        step = F.greatest(stop - lo, F.lit(0.0)) / _TAIL_STEPS

        def add(total: Column, x: Column) -> Column:
            sine = F.sin(lo + (x + 0.5) * step)
            return total + F.exp((dof - 1) / 2 * F.log1p(-sine * sine))

        return step * F.aggregate(
            F.sequence(F.lit(0), F.lit(_TAIL_STEPS - 1)), F.lit(0.0), add
        )

    return integral(start) / integral(F.lit(0.0))


def ols(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Ordinary least squares of ``label`` on ``features`` (with intercept)
    over the rows without a NULL in them: (variable, coef, p_value), one row
    per feature and one for ``Intercept``.

    One pass: a single partial aggregate gives means and covariances (their
    number is set by the features, not by the rows), and the sweep operator
    over that one row gives coefficients, residuals and standard errors.
    p-values are two-sided, by Student's t. A constant feature or a linear
    combination of those before it has NULL coefficient and p-value; with no
    degree of freedom left all p-values are NULL.
    """
    cols = [*features, label]
    last, size = len(features), len(cols)
    data = df.dropna(how="any", subset=cols).select(*(F.col(c).cast("double").alias(c) for c in cols))
    pairs = {
        (i, j): F.covar_pop(cols[i], cols[j]) for i in range(size) for j in range(i, size)
    }
    stats = data.agg(
        F.count(F.lit(1)).alias("_n"),
        F.array(*(F.avg(c) for c in cols)).alias("_mean"),
        F.array(*(pairs[min(i, j), max(i, j)] for i in range(size) for j in range(size))).alias("_cov"),
    ).withColumn("_s", _swept(F.col("_cov"), size))

    def swept(i: int, j: int) -> Column:
        return F.get("_s", F.lit(i * size + j))

    def mean(i: int) -> Column:
        return F.get("_mean", F.lit(i))

    def total(terms) -> Column:
        return sum(terms, F.lit(0.0))

    used = total((swept(i, i) > 0).cast("int") for i in range(last))
    spread = total(
        mean(i) * swept(i, j) * mean(j) for i in range(last) for j in range(last)
    )
    fitted = [
        F.struct(
            F.lit(name).alias("variable"),
            F.when(swept(i, i) > 0, swept(i, last)).alias("coef"),
            swept(i, i).alias("_v"),
        )
        for i, name in enumerate(features)
    ]
    intercept = F.struct(
        F.lit("Intercept").alias("variable"),
        (mean(last) - total(swept(i, last) * mean(i) for i in range(last))).alias("coef"),
        (1 + spread).alias("_v"),
    )
    # residual sum over n; the same n divides the coefficients' variances
    rows = stats.select(
        (F.col("_n") - 1 - used).alias("_dof"),
        F.greatest(swept(last, last), F.lit(0.0)).alias("_rss"),
        F.explode(F.array(*fitted, intercept)).alias("_f"),
    ).select("_dof", "_f.variable", "_f.coef",
             F.when(F.col("_dof") > 0, F.sqrt(F.col("_rss") / F.col("_dof") * F.col("_f._v"))).alias("_se"))
    t = F.abs(F.col("coef")) / F.col("_se")
    p = F.when(F.col("_se") > 0, _two_sided_p(t, F.col("_dof"))).when(
        (F.col("_se") == 0) & (F.col("coef") != 0), F.lit(0.0)
    )
    return rows.select("variable", "coef", p.alias("p_value"))


def ols_qr(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """``ols`` by a tree of QR factorisations (``plans.leastsquares``): for features that
    nearly depend on each other, whose covariances no longer tell them apart."""
    rows = leastsquares.fitted(df, label, features)
    t = F.abs(F.col("coef")) / F.col("se")
    p = F.when(F.col("se") > 0, _two_sided_p(t, F.col("dof"))).when(
        (F.col("se") == 0) & (F.col("coef") != 0), F.lit(0.0)
    )
    return rows.select("variable", "coef", p.alias("p_value"))
