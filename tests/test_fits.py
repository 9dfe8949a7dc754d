"""Tree QR and little bootstraps beside plain computations on one machine."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from souk.operators import analysis
from souk.plans import leastsquares
from souk.plans.bags import little_bootstrap_mean_ci
from souk.plans.distributions import bootstrap_mean_ci


def close(spark, n=4000, apart=1e-8, noise=0.0):
    rng = np.random.default_rng(1)
    a, z = rng.normal(size=n), rng.normal(size=n)
    b = a + apart * z
    y = 3 + a + 2 * b + noise * rng.normal(size=n)
    return spark.createDataFrame(np.column_stack([a, b, y]).tolist(), "a double, b double, y double").repartition(9)


def by_name(df):
    return {r["variable"]: r for r in df.collect()}


def test_nearly_collinear_features(spark):
    """Condition number 1e8: covariances lose the second feature, the factors keep it."""
    df = close(spark)
    got = by_name(analysis.ols_qr(df, "y", ["a", "b"]))
    assert got["a"]["coef"] == pytest.approx(1, abs=1e-6)
    assert got["b"]["coef"] == pytest.approx(2, abs=1e-6)
    assert got["Intercept"]["coef"] == pytest.approx(3, abs=1e-6)
    assert by_name(analysis.ols(df, "y", ["a", "b"]))["b"]["coef"] is None


@pytest.mark.parametrize("fan_in", [1, 2, 128])
def test_factors_equal_one_factorisation(spark, fan_in):
    df = close(spark, n=500, apart=0.5, noise=1.0)
    got = by_name(leastsquares.fitted(df, "y", ["a", "b"], fan_in))
    rows = np.array(df.collect())
    x = np.column_stack([np.ones(len(rows)), rows[:, :2]])
    beta, rss = np.linalg.lstsq(x, rows[:, 2])[:2]
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / (len(rows) - 3))
    for name, b, s in zip(["Intercept", "a", "b"], beta, se):
        assert got[name]["coef"] == pytest.approx(b) and got[name]["se"] == pytest.approx(s)
        assert got[name]["dof"] == len(rows) - 3
    swept = by_name(analysis.ols(df, "y", ["a", "b"]))
    factored = by_name(analysis.ols_qr(df, "y", ["a", "b"]))
    for name in swept:
        assert factored[name]["p_value"] == pytest.approx(swept[name]["p_value"], abs=1e-9)


def test_dependent_constant_missing_and_few_rows(spark):
    df = close(spark, n=300, apart=0.5, noise=1.0).withColumns(
        {"twice": 2 * F.col("a"), "const": F.lit(7.0), "big": F.col("b") * 1e-9 + 1e3}
    )
    got = by_name(analysis.ols_qr(df, "y", ["a", "twice", "const", "b"]))
    alone = by_name(analysis.ols_qr(df, "y", ["a", "b"]))
    assert got["twice"]["coef"] is None and got["const"]["p_value"] is None
    assert got["b"]["coef"] == pytest.approx(alone["b"]["coef"])
    holes = df.unionByName(df.limit(5).withColumn("a", F.lit(None).cast("double")))
    assert by_name(analysis.ols_qr(holes, "y", ["a", "b"]))["a"]["coef"] == pytest.approx(alone["a"]["coef"])
    assert {(r["coef"], r["p_value"]) for r in analysis.ols_qr(df.limit(0), "y", ["a"]).collect()} == {(None, None)}
    two = by_name(analysis.ols_qr(df.limit(2), "y", ["a"]))
    assert two["a"]["coef"] is not None and two["a"]["p_value"] is None
    endless = df.unionByName(df.limit(1).withColumn("y", F.lit(float("inf"))))
    assert by_name(analysis.ols_qr(endless, "y", ["a"]))["a"]["coef"] is None


def values(spark, n):
    x = F.pow(F.pmod(F.xxhash64("id"), F.lit(10_007)) / 10_007.0, F.lit(3.0))  # skewed
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").alias("g"), x.alias("v"))


def test_little_bootstraps_near_the_full_one(spark):
    """Interval ends within a fifth of the full bootstrap's width, which itself is the
    normal interval's within the same."""
    df = values(spark, 30_000)
    some = {r["g"]: r for r in little_bootstrap_mean_ci(df, ["g"], "v", "id", 300, subset_rows=1_000).collect()}
    full = {r["g"]: r for r in bootstrap_mean_ci(df.fillna("none"), ["g"], "v", "id", 300).collect()}
    for g, other in (("hot", "hot"), (None, "none")):
        a, b = some[g], full[other]
        assert a["n"] == b["n"] and a["mean"] == pytest.approx(b["mean"])
        assert a["n_subsets"] == min(20, a["n"] // 1_000)
        width, spread = b["ci_high"] - b["ci_low"], a["ci_high"] - a["ci_low"]
        assert abs(spread - width) < 0.2 * width
        # a subset's own mean is off by more than the interval; their average is not
        middle = (a["ci_high"] + a["ci_low"]) / 2
        assert abs(middle - (b["ci_high"] + b["ci_low"]) / 2) < 0.5 * width


def test_small_groups_are_one_subset(spark):
    df = values(spark, 900)
    got = {r["g"]: r for r in little_bootstrap_mean_ci(df, ["g"], "v", "id", 500).collect()}
    assert {r["n_subsets"] for r in got.values()} == {1}
    assert all(r["ci_low"] < r["mean"] < r["ci_high"] for r in got.values())
    again = {r["g"]: r for r in little_bootstrap_mean_ci(df.repartition(5), ["g"], "v", "id", 500).collect()}
    for g, r in got.items():
        assert again[g]["ci_low"] == pytest.approx(r["ci_low"], abs=1e-12)
    one = little_bootstrap_mean_ci(df.limit(1).withColumn("v", F.lit(4.0)), ["g"], "v", "id", 50).first()
    assert (one["ci_low"], one["mean"], one["ci_high"]) == (4.0, 4.0, 4.0)
    assert little_bootstrap_mean_ci(df.limit(0), ["g"], "v", "id").count() == 0
    assert little_bootstrap_mean_ci(df.withColumn("v", F.lit(None).cast("double")), ["g"], "v", "id").count() == 0
