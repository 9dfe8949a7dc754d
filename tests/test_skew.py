"""salted_join gives exactly the plain join, whether or not keys are split."""

from __future__ import annotations

import pytest

from souk.plans.skew import hot_keys, salted_join, sketch


@pytest.fixture(scope="module")
def frames(spark):
    # key 1 holds most rows; key None never matches; key 9 has no partner
    big = [(1, i) for i in range(3000)] + [(2, i) for i in range(5)] + [(None, 0), (9, 1)]
    other = [(1, "a"), (1, "b"), (2, "c"), (None, "n"), (3, "d")]
    return (
        spark.createDataFrame(big, "k int, v int"),
        spark.createDataFrame(other, "k int, w string"),
    )


def _rows(df):
    return sorted((tuple(r) for r in df.select("k", "v", "w").collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("rows_per_piece", [100, 10_000_000])
def test_salted_equals_plain(frames, how, rows_per_piece):
    big, other = frames
    plain = big.join(other, "k", how)
    salted = salted_join(big, other, "k", how, spread_by=["v"], rows_per_piece=rows_per_piece)
    assert _rows(salted) == _rows(plain)


@pytest.mark.parametrize("rows_per_piece", [100, 10_000_000])
def test_salted_anti_join_equals_plain(frames, rows_per_piece):
    big, other = frames
    plain = big.join(other, "k", "left_anti")
    salted = salted_join(big, other, "k", "left_anti", spread_by=["v"], rows_per_piece=rows_per_piece)
    assert sorted(map(repr, salted.collect())) == sorted(map(repr, plain.collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("rows_per_piece", [20, 10_000_000])
def test_both_sides_split_equals_plain(spark, how, rows_per_piece):
    # key 1 is hot on both sides, 2 only in the other, 3 only in the big side
    big = [(1, i) for i in range(300)] + [(2, 0), (2, 1), (9, 1), (None, 0)] + [(3, i) for i in range(300)]
    other = [(1, f"a{i}") for i in range(100)] + [(2, f"b{i}") for i in range(900)] + [(3, "c"), (None, "n")]
    big = spark.createDataFrame(big, "k int, v int")
    other = spark.createDataFrame(other, "k int, w string")
    plain = big.join(other, "k", how)
    salted = salted_join(
        big, other, "k", how, spread_by=["v"], other_spread_by=["w"], rows_per_piece=rows_per_piece
    )
    assert salted.columns == plain.columns
    assert _rows(salted) == _rows(plain)


def test_hot_key_table_is_bounded_by_the_partitions(spark):
    rows = [(k, v) for k in range(100) for v in range(50 + k)]
    hot = hot_keys(spark.createDataFrame(rows, "k int, v int"), "k", ["v"], rows_per_piece=20)
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r["k"] for r in hot.collect()) == list(range(100 - most, 100))


def test_hot_key_found_and_split(frames):
    big, _ = frames
    (row,) = hot_keys(big, "k", ["v"], rows_per_piece=100).collect()
    assert row["k"] == 1 and row["_pieces"] >= 10


def test_unique_lookup_left_join_dropped_when_unused(spark, frames):
    big, _ = frames
    lookup = spark.createDataFrame([(1, "x"), (2, "y")], "k int, w string")
    joined = salted_join(big, lookup, "k", "left", spread_by=["v"], other_unique=True)
    text = joined.select("k", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text


def test_rows_without_a_key_spread_over_tasks(spark):
    from pyspark.sql import functions as F

    from souk.plans.skew import salted_join

    big = spark.range(8000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    other = spark.range(8000).select(F.col("id").alias("k"), F.lit(1).alias("x"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = salted_join(big, other, "k", "left", spread_by=["v"])
        per_task = out.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in per_task) == 8000
        assert max(r["count"] for r in per_task) < 1.3 * 8000 / len(per_task)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


@pytest.mark.parametrize("limit", [20, 10_000_000])
@pytest.mark.parametrize("other_split", [False, True])
def test_full_join_with_sketched_keys(spark, limit, other_split):
    # 1 is hot on both sides, 2 only in the other, 3 only in the big side; 4 and 5 on one side
    big = [(1, i) for i in range(300)] + [(2, 0), (2, 1), (4, 1)] + [(None, i) for i in range(60)] + [(3, i) for i in range(300)]
    other = [(1, f"a{i}") for i in range(90 if other_split else 2)] + [(3, "c"), (5, "d"), (None, "n"), (None, "m")]
    other += [(2, f"b{i}") for i in range(400)] if other_split else [(2, "b")]
    big, other = spark.createDataFrame(big, "k int, v int"), spark.createDataFrame(other, "k int, w string")
    hot, many = sketch(big, ["k"], ["v"], limit)["k"], sketch(other, ["k"], ["w"], limit)["k"]
    if limit == 20:
        assert {k for k, _ in hot.pieces} == {"1", "3"} and hot.nulls
    got = salted_join(
        big, other, "k", "full", spread_by=["v"], hot=hot,
        other_spread_by=["w"] if other_split else None, other_hot=many if other_split else None,
    )
    assert got.columns == ["k", "v", "w"]
    assert _rows(got) == _rows(big.join(other, "k", "full"))


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
@pytest.mark.parametrize("limit", [100, 10_000_000])
def test_sketched_keys_give_the_plain_join(frames, how, limit):
    big, other = frames
    hot = sketch(big, ["k"], ["v"], limit)["k"]
    got = salted_join(big, other, "k", how, spread_by=["v"], hot=hot)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, big.join(other, "k", how).collect()))
    assert bool(hot.pieces) == (limit == 100)


def test_one_sketch_serves_all_columns(spark):
    rows = [(i % 3, "x" if i % 2 else None, i) for i in range(600)]
    df = spark.createDataFrame(rows, "a long, b string, i int")
    got = sketch(df, ["a", "b", "i"], ["i"], rows_per_piece=150)
    assert {k for k, n in got["a"].pieces} == {"0", "1", "2"} and all(n >= 2 for _, n in got["a"].pieces)
    assert [k for k, _ in got["b"].pieces] == ["x"] and got["b"].nulls
    assert got["i"].pieces == () and not got["i"].nulls
    assert got["a"].table(spark, "a").dtypes == [("a", "bigint"), ("_pieces", "int")]
