"""Invariants: row order and partitioning change nothing, costs and
segments add up, the curve starts at 0, densities integrate to 1."""

from __future__ import annotations

import math
import random
from dataclasses import fields

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from souk.functions.expr import haversine_km
from souk.operators import analysis, segments, sellers
from souk.operators.economics import DEFAULT_RATES
from souk.plans.distributions import kde, kde_binned
from souk.registry import marketplace
from souk.sources.catalog import Marketplace


@pytest.fixture(scope="module")
def m(spark) -> Marketplace:
    return marketplace(spark, SF_SMALL)


def _shuffled(m: Marketplace, seed: int, parts: int) -> Marketplace:
    def mix(df):
        return df.orderBy(F.rand(seed)).repartition(parts)

    tables = {f.name: getattr(m, f.name) for f in fields(m)}
    return Marketplace(**{k: mix(v) for k, v in tables.items() if v is not None})


def _as_set(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_seller_mart_ignores_row_order_and_partitioning(spark, m):
    base = _as_set(sellers.seller_mart(m))
    assert base == _as_set(sellers.seller_mart(_shuffled(m, 3, 5)))


def test_it_costs_add_up(m):
    n = sellers.quantity(m).select("seller_id", "n_orders")
    total = sellers.it_costs(n).agg(F.sum("it_costs")).collect()[0][0]
    assert total == pytest.approx(DEFAULT_RATES.it_total, rel=1e-12)


def test_segments_partition_the_sellers(m):
    ranked = segments.ranked_sellers(sellers.seller_mart(m), segments.Cutoffs(2, 4, 7))
    n = ranked.count()
    sizes = rows(segments.segment_sizes(segments.seller_segments(ranked)))
    assert sum(r["n_sellers"] for r in sizes) == n
    ranks = sorted(r["removal_rank"] for r in rows(ranked))
    assert ranks == list(range(1, n + 1))


def test_curve_starts_at_zero_and_ends_at_total(m):
    ranked = segments.ranked_sellers(sellers.seller_mart(m))
    curve = {r["n_sellers_removed"]: r["benefits_of_removing"]
             for r in rows(segments.removal_gain_curve(ranked))}
    assert curve[0] == 0.0
    mart = rows(sellers.seller_mart(m))
    total = sum(r["profits"] for r in mart if r["profits"] is not None)
    best = max(mart, key=lambda r: (r["profits"] is not None, r["profits"]))
    # removing everybody but the best seller leaves its profit
    assert curve[len(mart) - 1] == pytest.approx((best["profits"] - total) / total * 100)


def test_kde_integrates_to_one(spark):
    vals = [(g, float(x)) for g in ("a", "b") for x in (1, 2, 2, 3, 7, 8, 8.5, 13)]
    df = spark.createDataFrame(vals, "g string, v double")
    dens = rows(analysis.kde_by_dimension(df, "v", "g"))
    for g in ("a", "b"):
        pts = sorted((r["x"], r["density"]) for r in dens if r["g"] == g)
        assert len(pts) == 200
        area = sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(pts, pts[1:]))
        assert area == pytest.approx(1.0, abs=2e-3)


def test_kde_matches_closed_form(spark):
    data = [0.0, 1.0, 4.0]
    df = spark.createDataFrame([("g", v) for v in data], "g string, v double")
    (row,) = [r for r in rows(analysis.kde_by_dimension(df, "v", "g")) if r["point"] == 100]
    n = len(data)
    mean = sum(data) / n
    sd = math.sqrt(sum((v - mean) ** 2 for v in data) / (n - 1))
    bw = sd * n ** -0.2
    start, stop = min(data) - 3 * bw, max(data) + 3 * bw
    x = 100 * (stop - start) / 199 + start
    want = sum(math.exp(-0.5 * ((x - v) / bw) ** 2) for v in data) / (n * bw * math.sqrt(2 * math.pi))
    assert row["x"] == pytest.approx(x, rel=1e-12)
    assert row["density"] == pytest.approx(want, rel=1e-12)


coord = st.tuples(
    st.floats(min_value=-180, max_value=180, allow_nan=False),
    st.floats(min_value=-90, max_value=90, allow_nan=False),
)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(coord, coord), min_size=1, max_size=20))
def test_haversine_symmetric_and_zero_on_equal_points(spark, pairs):
    data = [(a[0], a[1], b[0], b[1]) for a, b in pairs]
    df = spark.createDataFrame(data, "lo1 double, la1 double, lo2 double, la2 double")
    c = F.col
    out = df.select(
        haversine_km(c("lo1"), c("la1"), c("lo2"), c("la2")).alias("ab"),
        haversine_km(c("lo2"), c("la2"), c("lo1"), c("la1")).alias("ba"),
        haversine_km(c("lo1"), c("la1"), c("lo1"), c("la1")).alias("aa"),
    ).collect()
    for r in out:
        assert r["ab"] == pytest.approx(r["ba"], abs=1e-6)
        assert r["aa"] == 0.0
        assert 0.0 <= r["ab"] <= math.pi * 6371 + 1e-6


def test_quantiles_match_linear_interpolation(spark):
    from souk.plans.distributions import grouped_quantiles

    vals = [1.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([("g", v, i) for i, v in enumerate(vals)], "g string, v double, i int")
    (r,) = rows(grouped_quantiles(df, ["g"], "v", {"q1": 0.25, "med": 0.5, "q3": 0.75}))
    assert (r["q1"], r["med"], r["q3"]) == (1.75, 2.5, 4.75)


def test_bootstrap_interval_contains_mean(m):
    seg = segments.seller_segments(
        segments.ranked_sellers(sellers.seller_mart(m), segments.Cutoffs(2, 4, 7))
    )
    for r in rows(analysis.mean_one_star_ci(seg)):
        if r["n"] > 1:
            assert r["ci_low"] <= r["mean"] <= r["ci_high"]


def test_violin_of_a_single_value_is_one_point(spark):
    df = spark.createDataFrame(
        [("Worst", "a", 5.0), ("Worst", "b", 5.0), ("Good", "c", 1.0), ("Good", "d", 3.0)],
        "profile string, seller_id string, sales_per_order double",
    )
    got = rows(analysis.violin_sales_per_order(df))
    worst = [r for r in got if r["profile"] == "Worst"]
    assert [(r["x"], r["density"], r["median"]) for r in worst] == [(5.0, 1.0, 5.0)]
    assert len([r for r in got if r["profile"] == "Good"]) == 100


def test_ols_matches_numpy_normal_equations(m):
    import numpy as np
    from math import erf, sqrt

    from souk.operators import orders
    from souk.registry import OLS_FEATURES

    feats = list(OLS_FEATURES)
    df = orders.order_features(m)
    got = {r["variable"]: r for r in rows(analysis.ols(df, "review_score", feats))}
    pdf = df.select("review_score", *feats).toPandas().dropna()
    x = np.column_stack([pdf[feats].to_numpy(float), np.ones(len(pdf))])
    y = pdf["review_score"].to_numpy(float)
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ beta
    dof = len(y) - x.shape[1]
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (resid @ resid) / dof)
    names = feats + ["Intercept"]
    for name, b, s in zip(names, beta, se):
        assert got[name]["coef"] == pytest.approx(b, rel=1e-6, abs=1e-9)
        # two-sided p-value; the t distribution is close to normal at this dof
        p_normal = 2 * (1 - 0.5 * (1 + erf(abs(b / s) / sqrt(2))))
        assert got[name]["p_value"] == pytest.approx(p_normal, abs=5e-3)


def test_two_sided_p_matches_tables(spark):
    # published two-sided 5 % and 1 % points of Student's t
    points = [(12.7062, 1, 0.05), (2.2281, 10, 0.05), (3.1693, 10, 0.01), (1.9840, 100, 0.05),
              (1.95996, 10**9, 0.05), (0.0, 7, 1.0)]
    df = spark.createDataFrame(points, "t double, dof long, p double")
    for r in df.withColumn("got", analysis._two_sided_p(F.col("t"), F.col("dof"))).collect():
        assert r["got"] == pytest.approx(r["p"], abs=5e-6)


def test_ols_dependent_features_and_empty_input(spark):
    df = spark.createDataFrame(
        [(float(i), 2.0 * i, 5.0, 3.0 * i + i % 3) for i in range(40)],
        "a double, twice double, const double, y double",
    )
    got = {r["variable"]: r for r in rows(analysis.ols(df, "y", ["a", "twice", "const"]))}
    alone = {r["variable"]: r for r in rows(analysis.ols(df, "y", ["a"]))}
    assert got["twice"]["coef"] is None and got["const"]["p_value"] is None
    for name in ("a", "Intercept"):
        assert got[name]["coef"] == pytest.approx(alone[name]["coef"])
        assert got[name]["p_value"] == pytest.approx(alone[name]["p_value"])
    empty = rows(analysis.ols(df.limit(0), "y", ["a"]))
    assert [(r["coef"], r["p_value"]) for r in empty] == [(None, None)] * 2
    (exact,) = [r for r in rows(analysis.ols(df, "twice", ["a"])) if r["variable"] == "a"]
    assert (exact["coef"], exact["p_value"]) == (2.0, 0.0)


def test_bootstrap_is_reproducible(m):
    seg = segments.seller_segments(
        segments.ranked_sellers(sellers.seller_mart(m), segments.Cutoffs(2, 4, 7))
    )
    a = sorted(map(tuple, analysis.mean_one_star_ci(seg, seed=3).collect()))
    b = sorted(map(tuple, analysis.mean_one_star_ci(seg, seed=3).collect()))
    assert a == b


def test_binned_kde_is_within_its_bound(spark):
    rng = random.Random(11)
    data = {
        "normal": [rng.gauss(3, 2) for _ in range(3000)],
        "two": [rng.gauss(rng.choice([-8, 8]), 0.5) for _ in range(2000)],
        "tail": [rng.lognormvariate(0, 1.2) for _ in range(2000)],
        "ties": [float(rng.randrange(4)) for _ in range(500)],
        "pair": [0.0, 1.0],
        "flat": [2.0] * 9,
    }
    df = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs], "g string, v double")
    exact = {(r["g"], r["point"]): (r["x"], r["density"]) for r in kde(df, ["g"], "v").collect()}
    got = {(r["g"], r["point"]): (r["x"], r["density"]) for r in kde_binned(df, ["g"], "v").collect()}
    assert exact.keys() == got.keys() and {g for g, _ in got} == set(data) - {"flat"}
    for g in data:
        peak = max((d for (k, _), (_, d) in exact.items() if k == g), default=0)
        for key, (x, d) in exact.items():
            if key[0] == g:
                assert got[key][0] == x and abs(got[key][1] - d) < 1e-4 * peak
