from __future__ import annotations

from collections import Counter
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from souk.llm import graph, registry, simhash
from souk.plans.skew import HOT_KEY_ROWS

from .conftest import SF, as_rows, pairs


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_components(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(nodes, 2):
        if near(a, b):
            parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def expected(rows, radius=2):
    prints = [(i, brute_print(t)) for i, t in rows]
    root = brute_components(sorted({p for _, p in prints}), lambda a, b: (a ^ b).bit_count() <= radius)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    return Counter((i, f"{p:016x}", least.get(root[p])) for i, p in prints)


def test_odd_rows(odd):
    got = simhash.near_duplicates(odd).select("doc_id", simhash.hex_of(F.col("fp")), "component_id")
    assert Counter(as_rows(got)) == expected(pairs(odd))


def test_query(spark, documents):
    got = registry.op7_simhash(spark, SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(as_rows(got)) == expected(pairs(documents))


def test_jvm_hash_is_the_same(spark):
    one = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()["h"]
    assert one % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("radius", [1, 2])
def test_links_connect_all_within_the_radius(spark, radius):
    import random

    rng = random.Random(radius)
    nodes = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        nodes.add(base)
        for _ in range(25):  # chains of flips: one large bucket
            base ^= 1 << rng.randrange(64)
            for _ in range(rng.randrange(0, radius + 1)):
                base ^= 1 << rng.randrange(64)
            nodes.add(base)
    nodes = sorted(nodes)
    signed = [(simhash._signed(n),) for n in nodes]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), radius)
    pairs_ = [(r["u"] % 2**64, r["v"] % 2**64) for r in links.collect()]
    assert all((u ^ v).bit_count() <= radius for u, v in pairs_)
    want = brute_components(nodes, lambda a, b: (a ^ b).bit_count() <= radius)
    root = {r["node"] % 2**64: r["root"] % 2**64 for r in graph.roots(links).collect()}
    got = {n: root.get(n, n) for n in nodes}
    same = lambda names: {frozenset(n for n in nodes if names[n] == v) for v in names.values()}
    assert same(got) == same(want)


def test_masks_cover_every_pair_of_bits():
    tables = simhash.masks(2)
    assert len(tables) == 7
    for i, j in combinations(range(64), 2):
        assert any(not m >> i & 1 and not m >> j & 1 for m in tables)


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_long_chain(spark):
    n = 40
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long")
    got = {r["node"]: r["root"] for r in graph.roots(links).collect()}
    assert got == {i: 0 for i in range(1, n + 1)}


@pytest.mark.parametrize("hub", [0, 700])
def test_hub_is_split(spark, hub):
    # one node in most links, above the (lowered) size of a piece
    leaves = [(hub, n) for n in range(1, 700)] + [(1000, 1001), (5, 6)]
    links = spark.createDataFrame(leaves, "u long, v long")
    spark.conf.set(HOT_KEY_ROWS, "100")
    try:
        got = {r["node"]: r["root"] for r in graph.roots(links).collect()}
    finally:
        spark.conf.unset(HOT_KEY_ROWS)
    first = min(hub, 1)
    nodes = set(range(1, 700)) | {hub}
    assert got == {n: first for n in nodes - {first}} | {1001: 1000}
