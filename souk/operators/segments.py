"""Seller ranking, removal what-if curve, segments, cohorts and rollups,
all over the seller mart."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.expr import round_half_even
from souk.plans.ranking import ordered
from souk.plans.selection import LAST_ROWS, fixed, order_statistics
from souk.plans.skew import salted_join


@dataclass(frozen=True)
class Cutoffs:
    """Segment cut-offs, counted from the least profitable seller.

    With ``of`` set, each cut-off is scaled to the actual number of sellers
    N as round(cutoff * N / of): the analysis' cut-offs keep their share of
    sellers on a smaller or larger mart.
    """

    # Worst 180, bad 500 and neutral 1300 sellers, set for a
    # mart of 2970 sellers.
    worst: int = 180
    bad: int = 500
    neutral: int = 1300
    of: int | None = None

    def scaled(self, n: Column) -> dict[str, Column]:
        def k(c: int) -> Column:
            if self.of is None:
                return F.lit(c).cast("bigint")
            return F.floor(F.lit(c) * n / F.lit(float(self.of)) + 0.5).cast("bigint")

        return {"k_worst": k(self.worst), "k_bad": k(self.bad), "k_neutral": k(self.neutral)}

    def counts(self, n: int) -> list[int]:
        """The worst, bad and neutral cut-off for ``n`` sellers."""
        at = (self.worst, self.bad, self.neutral)
        return [c if self.of is None else math.floor(c * n / float(self.of) + 0.5) for c in at]


ABSOLUTE_CUTOFFS = Cutoffs()
SCALED_CUTOFFS = Cutoffs(of=2970)

PROFILES = ("Worst", "Bad", "Neutral", "Good")


def removal_order() -> list[Column]:
    """NULL profits first, then ascending: the exact reverse of the ranking
    (profits descending, NULLs last, then seller_id, city, state)."""
    return [
        F.col("profits").asc_nulls_first(),
        F.col("seller_id").desc_nulls_last(),
        F.col("seller_city").desc_nulls_last(),
        F.col("seller_state").desc_nulls_last(),
    ]


def with_sales_per_order(mart: DataFrame) -> DataFrame:
    return mart.withColumn("sales_per_order", F.try_divide(F.col("sales"), F.col("n_orders")))


def ranked_sellers(mart: DataFrame, cutoffs: Cutoffs = ABSOLUTE_CUTOFFS) -> DataFrame:
    """Seller mart with sales_per_order and, per seller:

    * removal_rank: 1 for the least profitable (the first to remove);
    * profit_rank: 1 for the most profitable (= N + 1 - removal_rank);
    * removed_before: total profit of the sellers removed before it;
    * n_sellers, total_profits and the cut-offs k_worst/k_bad/k_neutral.

    Positions come from the distributed ranking plan; N and the total come
    from one scalar subquery, computed once.
    """
    base = with_sales_per_order(mart)
    pos = ordered(base, removal_order(), "removal_rank", running_of="profits",
                  running="removed_before")
    totals = pos.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum("profits").alias("total"))
    ).scalar()
    return (
        pos.withColumns(
            {"n_sellers": totals.getField("n"), "total_profits": totals.getField("total")}
        )
        .withColumns(cutoffs.scaled(F.col("n_sellers")))
        .withColumn("profit_rank", F.col("n_sellers") + 1 - F.col("removal_rank"))
    )


def seller_ranking(ranked: DataFrame) -> DataFrame:
    """Sellers by profit, best first (ties by seller_id)."""
    return ranked.select("seller_id", "profits", "sales_per_order", "profit_rank")


def removal_gain_curve(ranked: DataFrame) -> DataFrame:
    """% change of total profit when the n least profitable sellers are
    removed, for n = 0 .. N-1 (a NULL profit counts as 0)."""
    gain = F.try_divide(-F.col("removed_before"), F.col("total_profits")) * 100
    return ranked.select(
        (F.col("removal_rank") - 1).alias("n_sellers_removed"),
        gain.alias("benefits_of_removing"),
    )


def removal_gain_points(ranked: DataFrame) -> DataFrame:
    """The curve read at the three cut-offs, plus the best n (largest gain,
    smallest n among ties)."""
    curve = ranked.select(
        (F.col("removal_rank") - 1).alias("n_sellers_removed"),
        (F.try_divide(-F.col("removed_before"), F.col("total_profits")) * 100).alias(
            "benefits_of_removing"
        ),
        "k_worst", "k_bad", "k_neutral",
    )
    n = F.col("n_sellers_removed")
    labelled = curve.withColumn(
        "labels",
        F.filter(
            F.array(
                F.when(n == F.col("k_worst"), F.lit("worst")),
                F.when(n == F.col("k_bad"), F.lit("bad")),
                F.when(n == F.col("k_neutral"), F.lit("neutral")),
            ),
            lambda x: x.isNotNull(),
        ),
    )
    at_cutoffs = labelled.select(
        F.explode("labels").alias("point"), "n_sellers_removed", "benefits_of_removing"
    )
    key = F.struct(F.col("benefits_of_removing"), -F.col("n_sellers_removed"))
    best = curve.filter(F.col("benefits_of_removing").isNotNull()).agg(
        F.max_by("n_sellers_removed", key).alias("n_sellers_removed"),
        F.max("benefits_of_removing").alias("benefits_of_removing"),
    ).select(F.lit("best").alias("point"), "n_sellers_removed", "benefits_of_removing")
    return at_cutoffs.unionByName(best)


def _profile() -> Column:
    r = F.col("removal_rank")
    return (
        F.when(r <= F.col("k_worst"), "Worst")
        .when(r <= F.col("k_bad"), "Bad")
        .when(r <= F.col("k_neutral"), "Neutral")
        .otherwise("Good")
    )


@dataclass(frozen=True)
class _Cut:
    """The ``k`` first sellers in the order of removal: those below ``profits``
    and ``ties`` of the ``equal`` that have it (None: no profit)."""

    profits: float | None
    ties: int
    equal: int

    def holds(self, place: Column | None = None) -> Column:
        p = F.col("profits")
        below = F.lit(False) if self.profits is None else p.isNull() | (p < self.profits)
        tied = p.eqNullSafe(F.lit(self.profits).cast("double"))
        if place is not None:
            return below | (tied & (place <= self.ties))
        return below | tied if self.ties == self.equal else below


def _cuts(base: DataFrame, cutoffs: Cutoffs, last_rows: int) -> list[_Cut]:
    p = F.col("profits")
    size = base.agg(
        F.count(F.lit(1)).alias("n"), F.count(p).alias("_n"), F.min(p).alias("_lo"), F.max(p).alias("_hi")
    ).first()
    nulls = size["n"] - size["_n"]
    ks = [max(0, min(k, size["n"])) for k in cutoffs.counts(size["n"])]
    wanted = sorted({k - nulls - 1 for k in ks if k > nulls})
    values, beside = {}, {}
    if wanted:
        spark = base.sparkSession
        ranks = spark.createDataFrame(
            [(0, r, size["_n"], size["_lo"], size["_hi"]) for r in wanted],
            "_all int, _rank long, _n long, _lo double, _hi double",
        )
        vals = base.filter(p.isNotNull()).select(F.lit(0).alias("_all"), "profits")
        found = order_statistics(vals, ["_all"], "profits", ranks, last_rows=last_rows)
        values = {r["_rank"]: r["profits"] for r in found.collect()}
        counts = base.agg(*(F.struct(F.count_if(p < v), F.count_if(p == v)).alias(f"v{r}") for r, v in values.items())).first()
        beside = {r: tuple(counts[f"v{r}"]) for r in values}

    def cut(k: int) -> _Cut:
        if k <= nulls:
            return _Cut(None, k, nulls)
        less, equal = beside[k - nulls - 1]
        return _Cut(values[k - nulls - 1], k - nulls - less, equal)

    return [cut(k) for k in ks]


def profiled_sellers(
    mart: DataFrame, cutoffs: Cutoffs = ABSOLUTE_CUTOFFS, last_rows: int = LAST_ROWS
) -> DataFrame:
    """Seller mart with sales_per_order and the profile that ``seller_segments``
    gives, found without ranking the sellers: only the profits at the three
    cut-offs are selected. Sellers whose tie is divided by a cut-off are told
    apart by the order of removal among them."""
    base = fixed(with_sales_per_order(mart))
    cuts = _cuts(base, cutoffs, last_rows)

    def profile(place: Column | None = None) -> Column:
        worst, bad, neutral = (c.holds(place) for c in cuts)
        return F.when(worst, "Worst").when(bad, "Bad").when(neutral, "Neutral").otherwise("Good")

    divided = {c.profits: c.equal for c in cuts if 0 < c.ties < c.equal}
    if not divided:
        return base.withColumn("profile", profile())
    p = F.col("profits")
    tied = F.lit(False)
    for v in divided:
        tied = tied | p.eqNullSafe(F.lit(v).cast("double"))
    ties = base.filter(tied)
    if sum(divided.values()) <= last_rows:
        placed = ties.withColumn("_place", F.row_number().over(Window.partitionBy("profits").orderBy(*removal_order()[1:])))
    else:
        placed, before = ordered(ties, removal_order(), "_place"), 0
        first = F.lit(0)
        for v in sorted(divided, key=lambda x: (x is not None, x)):  # ties follow each other
            first = F.when(p.eqNullSafe(F.lit(v).cast("double")), F.lit(before)).otherwise(first)
            before += divided[v]
        placed = placed.withColumn("_place", F.col("_place") - first)
    apart = placed.withColumn("profile", profile(F.col("_place"))).drop("_place")
    return base.filter(~tied).withColumn("profile", profile()).unionByName(apart)


def seller_segments(ranked: DataFrame) -> DataFrame:
    """Disjoint profiles by removal rank: Worst, Bad, Neutral, Good."""
    return ranked.withColumn("profile", _profile())


def seller_cohorts(ranked: DataFrame) -> DataFrame:
    """Overlapping cohorts: the k_worst, k_bad and k_neutral least
    profitable sellers (nested), and the good ones beyond k_neutral; one row
    per (seller, cohort)."""
    r = F.col("removal_rank")
    names = F.filter(
        F.array(
            F.when(r <= F.col("k_worst"), F.lit("worst")),
            F.when(r <= F.col("k_bad"), F.lit("bad")),
            F.when(r <= F.col("k_neutral"), F.lit("neutral")),
            F.when(r > F.col("k_neutral"), F.lit("good")),
        ),
        lambda x: x.isNotNull(),
    )
    return ranked.withColumn("cohort", F.explode(names))


def segment_sizes(segments: DataFrame) -> DataFrame:
    return segments.groupBy("profile").agg(F.count(F.lit(1)).alias("n_sellers"))


def behaviour_points(
    mart: DataFrame, max_one_star: float = 0.3, max_sales_per_order: float = 500.0
) -> DataFrame:
    """Per seller: share of one-star reviews, sales per order, sales and
    profits, flagged when inside the displayed window."""
    spo = F.col("sales_per_order")
    share = F.col("share_of_one_stars")
    return with_sales_per_order(mart).select(
        "seller_id", "share_of_one_stars", "sales_per_order", "sales", "profits",
        F.coalesce(
            share.between(0.0, max_one_star) & spo.between(0.0, max_sales_per_order),
            F.lit(False),
        ).alias("in_window"),
    )


@dataclass(frozen=True)
class RiskRule:
    # Fixed values of the at-risk pattern: more than 10 % one-star reviews,
    # more than 12 days of customer wait, less than 200 of sales per order.
    min_share_of_one_stars: float = 0.10
    min_wait_time: float = 12.0
    max_sales_per_order: float = 200.0


def at_risk_sellers(mart: DataFrame, rule: RiskRule = RiskRule()) -> DataFrame:
    """Sellers matching the at-risk pattern."""
    return (
        with_sales_per_order(mart)
        .filter(
            (F.col("share_of_one_stars") > rule.min_share_of_one_stars)
            & (F.col("wait_time") > rule.min_wait_time)
            & (F.col("sales_per_order") < rule.max_sales_per_order)
        )
        .select("seller_id", "share_of_one_stars", "wait_time", "sales_per_order", "profits")
    )


CITY_ROLLUP = (
    "seller_city", "avg_delay_to_carrier", "avg_wait_time", "avg_active_months",
    "avg_review_score", "total_profits", "total_sales", "n_sellers", "lat", "lng",
)


def city_rollup(mart: DataFrame) -> DataFrame:
    """Per city: mean delay to carrier, wait, active months and review
    score (rounded to 1 decimal, then to 0, ties to even), total profits and
    sales (rounded to 0), seller count, and the sellers' points rounded to 2
    decimals; rows with a NULL are dropped, duplicates removed.

    Two partial aggregates over the mart: the distinct rounded points, and
    one row of statistics per city that they are joined to.
    """
    city = mart.filter(F.col("seller_city").isNotNull())

    def twice(c: str) -> Column:
        return round_half_even(round_half_even(F.avg(c), 1), 0)

    points = city.select(
        "seller_city",
        round_half_even(F.col("geolocation_lat"), 2).alias("lat"),
        round_half_even(F.col("geolocation_lng"), 2).alias("lng"),
    ).distinct()
    stats = city.groupBy("seller_city").agg(
        twice("delay_to_carrier").alias("avg_delay_to_carrier"),
        twice("wait_time").alias("avg_wait_time"),
        twice("active_months").alias("avg_active_months"),
        twice("review_score").alias("avg_review_score"),
        round_half_even(F.coalesce(F.sum("profits"), F.lit(0.0)), 0).alias("total_profits"),
        round_half_even(F.coalesce(F.sum("sales"), F.lit(0.0)), 0).alias("total_sales"),
        F.count("seller_id").alias("n_sellers"),
    )
    return (
        salted_join(points, stats, "seller_city", spread_by=["lat", "lng"])
        .select(*CITY_ROLLUP)
        .dropna(how="any")
    )
