"""Order statistics, quantiles and profiles selected without a sort."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from souk.operators import segments
from souk.plans.distributions import grouped_quantiles
from souk.plans.selection import fixed, group_stats, order_statistics


def groups(rng):
    return {
        "even": [float(i) for i in range(300)],
        "ties": [rng.choice([1.0, 2.0, 2.0, 2.0, 7.5]) for _ in range(400)],
        "one": [3.25] * 50,
        "single": [-1.0],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-30, 30) for _ in range(200)],
        "near": [1.0 + i * 2.0**-52 for i in range(100)],
        "normal": [rng.gauss(0, 1) for _ in range(500)],
    }


def selected(spark, data, **options):
    rows = [(g, x) for g, xs in data.items() for x in xs]
    random.Random(1).shuffle(rows)
    vals = fixed(spark.createDataFrame(rows, "g string, v double").repartition(5))
    stats = group_stats(vals, ["g"], "v")
    ranks = stats.withColumn(
        "_rank", F.explode(F.array_distinct(F.array(F.lit(0), *(F.floor((F.col("_n") - 1) * F.lit(p)) for p in (0.25, 0.5, 0.9, 1.0)))))
    )
    got = order_statistics(vals, ["g"], "v", ranks, **options).collect()
    assert len({(r["g"], r["_rank"]) for r in got}) == len(got)
    return {(r["g"], r["_rank"]): r["v"] for r in got}


@pytest.mark.parametrize("options", [{}, {"last_rows": 0, "bins": 64, "most_rounds": 6}, {"last_rows": 30, "bins": 8, "most_rounds": 2}])
def test_against_a_sort(spark, options):
    data = groups(random.Random(2))
    got = selected(spark, data, **options)
    for (g, rank), v in got.items():
        assert v == sorted(data[g])[rank], (g, rank)
    assert all((g, len(xs) - 1) in got and (g, 0) in got for g, xs in data.items())


@pytest.mark.parametrize("last_rows", [0, 1000])
def test_infinite_values_and_nan(spark, last_rows):
    inf, nan = math.inf, math.nan
    data = {"a": [-inf, 1.0, 2.0, inf, inf], "b": [nan, 1.0, 5.0, nan], "c": [1e308, -1e308, 0.0, 5e307]}
    order = lambda x: (math.isnan(x), x)
    for (g, rank), v in selected(spark, data, last_rows=last_rows).items():
        want = sorted(data[g], key=order)[rank]
        assert v == want or (math.isnan(v) and math.isnan(want))


def test_quantiles_by_rounds_equal_the_window(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xyz"), rng.choice([None, rng.gauss(5, 2), 4.0])) for _ in range(900)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"q1": 0.25, "q2": 0.5, "q9": 0.93}
    by_window = sorted(map(tuple, grouped_quantiles(df, ["g"], "v", probs).collect()))
    assert sorted(map(tuple, grouped_quantiles(df, ["g"], "v", probs, last_rows=0).collect())) == by_window
    for g, *qs in by_window:
        xs = sorted(v for k, v in rows if k == g and v is not None)
        for p, q in zip(probs.values(), qs):
            h = (len(xs) - 1) * p
            lo = xs[math.floor(h)]
            assert q == lo + (xs[math.ceil(h)] - lo) * (h - math.floor(h))


@pytest.mark.parametrize("last_rows", [0, 1000])
@pytest.mark.parametrize("cutoffs", [(3, 7, 20), (0, 25, 60), (12, 12, 500)])
def test_profiles_equal_the_ranking(spark, last_rows, cutoffs):
    rng = random.Random(sum(cutoffs))
    rows = [
        (i % 55, rng.choice(["a", "b", None]), "s", rng.choice([None, None, 5.0, 5.0, 1.0, rng.gauss(0, 9)]), 10.0, 2) for i in range(60)
    ]
    mart = spark.createDataFrame(
        rows, "seller_id int, seller_city string, seller_state string, profits double, sales double, n_orders int"
    )
    at = segments.Cutoffs(*cutoffs)
    want = segments.seller_segments(segments.ranked_sellers(mart, at))
    cols = ["seller_id", "seller_city", "profits", "sales_per_order", "profile"]
    rows_of = lambda df: sorted(map(repr, df.select(*cols).collect()))
    assert rows_of(segments.profiled_sellers(mart, at, last_rows)) == rows_of(want)


def test_no_range_sort_in_the_box_plan(spark):
    from conftest import SF_SMALL
    from souk.registry import spark_query

    text = spark_query("box_wait_time")(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in text
