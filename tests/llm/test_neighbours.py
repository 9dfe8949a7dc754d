from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from souk.llm import neighbours, registry

from .conftest import SF

SCHEMA = "vec_id long, embedding array<float>, qid string, part long"


def brute(rows, k=20, every=20):
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], np.float64)
    out = {}
    for i in ids[ids % every == 0]:
        score = (x * np.asarray(rows[i], np.float64)).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_query_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = {r["vec_id"]: r["embedding"] for r in table}
    want, got = brute(rows), found(registry.op6_neighbours(spark, SF))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, near in got.items():
        for i, score in near:
            assert abs(score - float(np.dot(np.float64(rows[q]), np.float64(rows[i])))) < 1e-9
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_all_parts_probed_is_exact_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = {i: rng.normal(size=6).round(2).astype(np.float32).tolist() for i in range(1, 150)}
    for i in range(200, 400):
        rows[i] = rows[7]  # one vector of very many rows
    odd = [(None, rows[1]), (500, None), (520, [0.0] * 6), (540, [float("nan")] + [1.0] * 5),
           (560, [float("inf")] + [1.0] * 5), (580, [None] + [1.0] * 5), (600, [1.0, 2.0]), (620, [])]
    table = [(i, v, "x", 3) for i, v in [*rows.items(), *odd, (20, rows[20])]]
    got = found(neighbours.search(
        spark.createDataFrame(table, SCHEMA), F.col("_id") % 20 == 0, entries_per_part=16, cell=32, probes=99
    ))
    want = brute(rows)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], "", 0), (1, [0.5, 1.0], "", 0), (40, [2.0, 1.0], "", 0)], SCHEMA)
    got = found(neighbours.search(few, F.col("_id") % 20 == 0))
    assert got == {0: [(40, 2.0), (1, 0.5)], 40: [(0, 2.0), (1, 2.0)]}
    assert neighbours.search(spark.createDataFrame([], SCHEMA), F.col("_id") % 20 == 0).count() == 0
    assert neighbours.search(spark.createDataFrame([(0, [1.0], "", 0)], SCHEMA), F.col("_id") % 20 == 0).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(1).normal(size=(500, 8))
    graph = neighbours.exact_neighbours(x, x, 8, np.arange(500))
    label = neighbours.balanced_parts(graph, 8, np.random.default_rng(0))
    assert np.bincount(label).max() - np.bincount(label).min() <= 2
    cut = (label[graph] != label[:, None]).mean()
    assert cut < 0.7  # 0.875 by chance


def test_recall_with_several_parts_and_fitted_probes(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12))
    x = (centres[rng.integers(0, 40, 3000)] + 0.6 * rng.normal(size=(3000, 12))).astype(np.float32)
    rows = {i: v.tolist() for i, v in enumerate(x, 1)}
    _, probes = neighbours.fit(x.astype(np.float64), 16, 20, neighbours.TARGET_RECALL)
    assert 1 < probes < 16
    table = spark.createDataFrame([(i, v, "", 0) for i, v in rows.items()], SCHEMA)
    got, want = found(neighbours.search(table, F.col("_id") % 20 == 0, entries_per_part=188)), brute(rows)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    print("recall", hits / (20 * len(want)), "probes", probes)
    assert hits >= 0.97 * 20 * len(want)
