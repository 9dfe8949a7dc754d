"""Approximate nearest neighbours over learned partitions.

A bounded sample of the distinct vectors gets its exact neighbour graph,
which recursive spectral bisection at the median cuts into balanced parts: few
neighbours are separated and all parts are of equal size. A small
classifier (a network with one hidden layer) learns from a vector the parts of its neighbours. All
distinct vectors are put into their most probable part; a query is routed to
its most probable ``probes`` parts, whose vectors are compared exactly.
``probes`` is the least number that finds ``target_recall`` of the exact
neighbours of held-back sample vectors. (Vectors without any structure, such
as uniform ones of many dimensions, need most parts for that; no routing helps.)

Equal vectors are one entry with their smallest k + 1 ids (no other of them can be
among k nearest), so a vector of very many rows is compared once. A part is
compared in cells of at most ``cell`` entries by ``cell`` queries.

The sample (``sample`` vectors, the first by hash) is fitted in one task; its bound is a
parameter. Every row is indexed.

Nearness is the inner product in double precision on the given vectors; ties
go to the smaller id. Defined results: vectors that are null, zero or hold
null or non-finite components take no part, nor do null ids and vectors of another length
than most have; repeated rows count once; fewer candidates than k give all;
an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import staged

K = 20
SAMPLE = 8_192
CELL = 8_192
ENTRIES_PER_PART = 8_192
MOST_PARTS = 256
TARGET_RECALL = 0.985
GRAPH_NEIGHBOURS = 16


# --- the index's model, fitted on the sample in one task ---------------------


def exact_neighbours(queries: np.ndarray, vectors: np.ndarray, k: int, own: np.ndarray | None) -> np.ndarray:
    out = []
    for at in range(0, len(queries), 512):
        scores = queries[at : at + 512] @ vectors.T
        if own is not None:
            some = own[at : at + 512]
            scores[np.arange(len(some)), some] = -np.inf
        out.append(np.argpartition(-scores, min(k, scores.shape[1] - 1), axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, rng) -> np.ndarray:
    """Recursive bisection of the neighbour graph, each time at the median of
    the second eigenvector of the normalised adjacency."""
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    label = np.zeros(n, np.int64)
    while label.max() + 1 < parts:
        inside = label[a] == label[b]
        u, v = a[inside], b[inside]
        degree = np.bincount(u, minlength=n) + 1.0
        root = np.sqrt(degree)
        groups = label.max() + 1
        x = rng.normal(size=n)
        for _ in range(60):
            # the trivial vector of each group is the root of its degrees
            along = np.bincount(label, x * root, groups) / np.bincount(label, degree, groups)
            x = x - along[label] * root
            x /= np.sqrt(np.bincount(label, x * x, groups) + 1e-30)[label]
            y = np.bincount(u, (x / root)[v], n) / root + x / degree
            x = 0.5 * (x + y)
        order = np.lexsort((np.arange(n), x / root, label))
        size = np.bincount(label, minlength=groups)
        rank = np.arange(n) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        upper = rank >= (size[label[order]] + 1) // 2
        new = np.empty(n, np.int64)
        new[order] = 2 * label[order] + upper
        label = new
    return label


class Router:
    """One hidden layer and a softmax over the parts."""

    def __init__(self, w1, b1, w2, b2, scale):
        self.w1, self.b1, self.w2, self.b2, self.scale = w1, b1, w2, b2, scale

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def fit_router(x: np.ndarray, target: np.ndarray, rng, hidden: int = 96, steps: int = 900) -> Router:
    parts, scale = target.shape[1], float(np.sqrt((x * x).mean()) + 1e-12)
    p = [
        rng.normal(size=(x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]),
        np.zeros(hidden),
        rng.normal(size=(hidden, parts)) * np.sqrt(1 / hidden),
        np.zeros(parts),
    ]
    m, s = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    z = x / scale
    for step in range(1, steps + 1):
        some = rng.integers(0, len(z), min(512, len(z)))
        a = np.maximum(z[some] @ p[0] + p[1], 0)
        o = a @ p[2] + p[3]
        o = np.exp(o - o.max(1, keepdims=True))
        o = (o / o.sum(1, keepdims=True) - target[some]) / len(some)
        da = (o @ p[2].T) * (a > 0)
        grads = [z[some].T @ da, da.sum(0), a.T @ o, o.sum(0)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g * g
            p[i] -= 0.01 * (1 - step / (steps + 1)) * (m[i] / (1 - 0.9**step)) / (
                np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8
            )
    return Router(*p, scale)


def fit(x: np.ndarray, parts: int, k: int, target_recall: float, seed: int = 11) -> tuple[Router, int]:
    """(router, probes) from a sample of vectors."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    back = order[: max(1, min(512, len(x) // 8))]
    own = np.arange(len(x))
    graph = exact_neighbours(x, x, min(GRAPH_NEIGHBOURS, max(1, len(x) - 1)), own)
    label = balanced_parts(graph, parts, rng)
    target = np.zeros((len(x), parts))
    for column in graph.T:
        target[own, label[column]] += 1
    target[own, label] += graph.shape[1] / 2
    target /= target.sum(1, keepdims=True)
    seen = np.setdiff1d(own, back) if len(x) > 64 else own
    router = fit_router(x[seen], target[seen], rng)
    home = router.scores(x).argmax(1)
    true = exact_neighbours(x[back], x, min(k, max(1, len(x) - 1)), back)
    place = np.argsort(np.argsort(-router.scores(x[back]), axis=1), axis=1)
    needed = place[np.arange(len(back))[:, None], home[true]]
    for probes in range(1, parts + 1):
        if (needed < probes).mean() >= target_recall:
            break
    return router, probes


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def train(entries: DataFrame, parts: int, k: int, sample: int, target_recall: float):
    """(router, probes), or None without entries."""
    def run(batches):
        x = np.concatenate([_matrix(b.column("vector")) for b in batches] or [np.zeros((0, 1))])
        if len(x):
            router, probes = fit(x, parts, k, target_recall)
            model = pickle.dumps((vars(router), probes))
            yield pa.RecordBatch.from_arrays([pa.array([model])], names=["m"])

    first = entries.orderBy("cid").limit(sample)  # cid is a hash
    row = first.repartitionByRange(1, "cid").sortWithinPartitions("cid").select("vector").mapInArrow(run, "m binary").first()
    if row is None:
        return None
    weights, probes = pickle.loads(row["m"])
    return Router(**weights), probes


# --- index and search -------------------------------------------------------


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, vector) of the rows that take part, vectors in double precision."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = (
        rows.select(F.col(id_col).cast("long").alias("_id"), vector.alias("vector"))
        .filter(F.col("_id").isNotNull() & F.col("vector").isNotNull())
        .filter(finite & F.exists("vector", lambda x: x != 0))
    )
    size = out.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    most = size.orderBy(F.desc("c"), "n").first()
    return out.filter(F.size("vector") == (most["n"] if most else 0))


def search(
    rows: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    sample: int = SAMPLE,
    cell: int = CELL,
    entries_per_part: int = ENTRIES_PER_PART,
    target_recall: float = TARGET_RECALL,
    probes: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for
    which ``is_query`` (a condition on ``_id``) holds."""
    spark = rows.sparkSession
    keyed = usable(rows, id_col, vector_col).withColumn(
        "cid", F.concat(F.hex(F.xxhash64("vector")), F.lit("-"), F.hex(F.xxhash64(F.lit(5), F.col("vector"))))
    )
    ids = staged(keyed.select("_id", "cid", is_query.alias("asked")).distinct(), "ann-ids")
    # each task keeps the smallest k + 1 ids of a vector before rows move
    smallest = ids.select("_id", "cid").distinct().withColumn(
        "_r", F.row_number().over(Window.partitionBy("cid").orderBy("_id"))
    ).filter(F.col("_r") <= k + 1)
    members = smallest.groupBy("cid").agg(F.sort_array(F.collect_list("_id")).alias("ids"))
    vectors = keyed.groupBy("cid").agg(F.first("vector").alias("vector"))
    asked = ids.filter("asked").select("cid").distinct().withColumn("asked", F.lit(True))
    entries = staged(
        vectors.join(members, "cid").join(asked, "cid", "left")
        .withColumn("asked", F.coalesce("asked", F.lit(False))),
        "ann-entries",
    )
    n = entries.count()
    parts = 1
    while parts < MOST_PARTS and parts * entries_per_part < n:
        parts *= 2
    parts = min(parts, max(1, 2 ** (max(1, min(n, sample) // (2 * k)).bit_length() - 1)))
    fitted = train(entries, parts, k, sample, target_recall)
    router, found_probes = fitted if fitted else (None, 1)
    probes = min(parts, probes or found_probes)
    shared = spark.sparkContext.broadcast(router)  # a fixed size

    def place(batches):
        for batch in batches:
            scores = shared.value.scores(_matrix(batch.column("vector")))
            ranked = np.argsort(-scores, axis=1, kind="stable")[:, :]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(ranked), pa.list_(pa.int64()))],
                names=[*batch.schema.names, "ranked"],
            )

    schema = entries.withColumn("ranked", F.array(F.lit(0).cast("long"))).schema
    placed = staged(entries.mapInArrow(place, schema).withColumn("part", F.element_at("ranked", 1)), "ann-placed")
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    while probes < parts and sum(sorted(sizes.get(p, 0) for p in range(parts))[:probes]) <= k:
        probes += 1  # enough candidates, whichever parts are probed
    routed = placed.filter("asked").select(
        F.col("cid").alias("qid"), F.col("vector").alias("probe"), F.explode(F.slice("ranked", 1, probes)).alias("part")
    )
    asks = {r["part"]: r["n"] for r in routed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = spark.createDataFrame(  # one row per part, at most MOST_PARTS
        [(p, -(-sizes.get(p, 1) // cell), -(-asks.get(p, 1) // cell)) for p in range(parts)],
        "part long, blocks long, turns long",
    )
    block = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    turn = F.pmod(F.xxhash64("qid"), F.col("turns"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = placed.join(F.broadcast(cells), "part").select(
        "part", block.alias("block"), every("turns").alias("turn"), "cid", "vector",
        F.element_at("ids", 1).alias("least"),
    )
    right = routed.join(F.broadcast(cells), "part").select(
        "part", every("blocks").alias("block"), turn.alias("turn"), "qid", "probe"
    )

    def compare(table, queries):
        best = {"qid": [], "cid": [], "score": []}
        if table.num_rows and queries.num_rows:
            table = table.sort_by("cid")
            x, q = _matrix(table.column("vector")), _matrix(queries.column("probe"))
            least = table.column("least").to_numpy()
            cids = np.array(table.column("cid").to_pylist(), object)
            qids = queries.column("qid").to_pylist()
            slack = 1e-9 * (np.abs(x).max() * np.abs(q).max() * x.shape[1] + 1e-300)
            for at in range(0, len(q), 256):
                rough = q[at : at + 256] @ x.T
                for i, row in enumerate(rough):
                    m = min(k + 1, len(row))
                    near = np.flatnonzero(row >= np.partition(row, len(row) - m)[len(row) - m] - slack)
                    # summed in one fixed order: equal vectors get equal scores
                    score = (x[near] * q[at + i]).sum(1)
                    near, score = near[(o := np.lexsort((least[near], -score)))][:m], score[o][:m]
                    best["qid"] += [qids[at + i]] * len(near)
                    best["cid"] += cids[near].tolist()
                    best["score"] += score.tolist()
        return pa.table(
            {"qid": pa.array(best["qid"], pa.string()), "cid": pa.array(best["cid"], pa.string()),
             "score": pa.array(best["score"], pa.float64())}
        )

    key = ["part", "block", "turn"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "qid string, cid string, score double")
    hits = hits.join(placed.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("id"))
    best = hits.withColumn(
        "_r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    ).filter(F.col("_r") <= k + 1)
    best = best.groupBy("qid").agg(  # k + 1 at most
        F.array_sort(F.collect_list(F.struct("_r", "id", "score"))).alias("near")
    )
    asked_ids = ids.filter("asked").select(F.col("_id").alias("query_id"), F.col("cid").alias("qid"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return (
        asked_ids.join(best, "qid")
        .select("query_id", F.posexplode(others).alias("_p", "x"))
        .select(
            "query_id",
            (F.col("_p") + 1).cast("int").alias("rank"),
            F.col("x.id").alias("vec_id"),
            F.col("x.score").alias("score"),
        )
    )
