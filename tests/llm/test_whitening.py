from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from souk.llm import registry, whitening

from .conftest import SF

ROWS = StructType(
    [
        StructField("vec_id", LongType()),
        StructField("embedding", ArrayType(DoubleType())),
        # names of the result and of the operator's own columns
        StructField("component", StringType()),
        StructField("n", StringType()),
        StructField("_vector", StringType()),
    ]
)


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in vectors], ROWS)


def check(vectors, got, components=8):
    kept = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    d = Counter(len(v) for _, v in kept).most_common(1)[0][0]
    kept = [(i, v) for i, v in kept if len(v) == d]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    v = centred.T @ centred / n
    e, c = np.linalg.eigh(v)
    e, c = e[::-1], c[:, ::-1]
    k = min(components, int((e > 1e-9 * e[0]).sum())) if e[0] > 0 else 0
    assert len(got) == n * k
    assert Counter((r["vec_id"], r["deviation"]) for r in got) == Counter(
        {key: c * k for key, c in Counter((i, s if s < 2**63 else None) for (i, _), s in zip(kept, deviation)).items()}
    )
    by = {j: [r for r in got if r["component"] == j] for j in range(1, k + 1)}
    for j in range(1, k + 1):
        assert {r["n"] for r in by[j]} == {n}
        for r in by[j]:
            assert r["explained"] == pytest.approx(e[j - 1] / np.trace(v), rel=1e-4)
            assert 0 <= r["identity_error"] <= 1e-4
    ids = [i for i, _ in kept]
    if k and len(set(ids)) == n:
        w = np.array([[r["whitened"] for r in sorted(by[j], key=lambda r: ids.index(r["vec_id"]))] for j in by]).T
        assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-8
        # the component that the whitened values come from is an eigenvector of v
        axes = centred.T @ w / n
        for j in range(k):
            axis = axes[:, j] / np.linalg.norm(axes[:, j])
            assert np.linalg.norm(v @ axis - e[j] * axis) <= 1e-9 * e[0]


def test_brute_force(spark):
    rng = np.random.default_rng(3)
    scale = np.array([9, 5, 5, 3, 2, 1, 0.5, 0.2, 0.1, 0.0])
    vectors = [(i, (rng.normal(size=10) * scale + 50).tolist()) for i in range(300)]
    check(vectors, whitening.whiten(table(spark, vectors)).collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    vectors += [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, math.nan, 2.0]), (54, [math.inf, 0.0, 0.0]),
                (55, [1.0, 2.0]), (56, [1.0] * 7), (57, [0.0, 0.0, 0.0]), (None, [0.5, 0.25, -0.5])]
    check(vectors, whitening.whiten(table(spark, vectors)).collect())
    # a row with equal id and vector, an id with two vectors
    vectors += [(1, vectors[1][1]), (2, [5.0, 5.0, 5.0])]
    check(vectors, whitening.whiten(table(spark, vectors)).collect())


def test_low_rank_equal_and_single(spark):
    rng = np.random.default_rng(5)
    line = [(i, [float(a), 2.0 * float(a), 7.0]) for i, a in enumerate(rng.integers(-9, 9, 30))]
    check(line, whitening.whiten(table(spark, line)).collect())
    equal = [(i, [3.0, 4.0]) for i in range(5)]
    assert whitening.whiten(table(spark, equal)).collect() == []
    assert whitening.whiten(table(spark, [(1, [3.0, 4.0])])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
    empty = whitening.whiten(table(spark, []))
    assert empty.collect() == [] and empty.columns[0] == "vec_id"


def test_huge_entries(spark):
    vectors = [(i, [1e9 * i, float(i % 3), 1.0 + i * i]) for i in range(20)]
    check(vectors, whitening.whiten(table(spark, vectors)).collect())
    assert whitening.whiten(table(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0])])).count() > 0


def test_any_partitioning(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, rng.normal(size=5).tolist()) for i in range(100)]
    rows = table(spark, vectors)
    for parts in (1, 7, 60):
        check(vectors, whitening.whiten(rows.repartition(parts)).collect())


def test_factor_and_jacobi():
    rng = np.random.default_rng(7)
    for d, rank in ((1, 1), (6, 6), (9, 4), (40, 40)):
        b = rng.normal(size=(d, rank)) * np.logspace(0, -5, rank)
        a = b @ b.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape[1] <= min(d, rank + 1)
        assert np.abs(factor @ factor.T - a).max() <= 1e-13 * np.abs(a).max()
        values, vectors = whitening.one_sided_jacobi(factor)
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
        assert np.all(np.diff(values) <= 0)
        # relative accuracy down to the small eigenvalues: singular values squared
        exact = np.linalg.svd(b, compute_uv=False) ** 2
        assert values[: min(rank, 3)] == pytest.approx(exact[: min(rank, 3)], rel=1e-9)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_query(spark):
    got = registry.QUERIES["op13_whitening"](spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    check([(r[0], r[1]) for r in rows], got.collect())
