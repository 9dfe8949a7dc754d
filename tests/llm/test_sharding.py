from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest

from souk.llm import registry, sharding

from .conftest import SF, make_docs, odd_rows


def brute_capacity(sizes, shards):
    def fits(capacity):
        used, load = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            if load + s > capacity:
                used, load = used + 1, 0
            load += s
        return used <= shards

    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def check(rows, got, shards):
    text = {i: t or "" for i, t, *_ in rows}
    assert sorted(r["doc_id"] or 0 for r in got) == sorted(i or 0 for i, *_ in rows)
    groups, least = defaultdict(int), {}
    for i, t, *_ in rows:
        groups[t or ""] += len((t or "").encode()) + 1
        least[t or ""] = min(least.get(t or "", 2**63), -(2**63) if i is None else i)
    key = lambda t: (least[t], __import__("hashlib").sha256(t.encode()).hexdigest())
    order = sorted(groups, key=key)
    best = brute_capacity([groups[t] for t in order], shards)
    loads, homes, slots = defaultdict(int), defaultdict(set), defaultdict(list)
    for r in got:
        if r["doc_id"] is not None:
            body = text[r["doc_id"]]
            assert r["size"] == len(body.encode()) + 1 and r["text_crc32"] == zlib.crc32(body.encode())
            homes[body].add(r["shard"])
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert max(loads.values()) == best
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(loads) <= set(range(shards))


@pytest.mark.parametrize("shards, piece", [(8, None), (3, 1), (1, 2)])
def test_odd_rows(odd, shards, piece):
    check(odd_rows(), sharding.shard(odd, shards=shards, rows_per_piece=piece).collect(), shards)


def test_query(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = registry.op4_sharding(spark, SF)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check(rows, got.collect(), 8)


def test_search_equals_brute_force(spark):
    rng = random.Random(3)
    for sizes in ([5], [rng.randrange(1, 900) for _ in range(200)], [3, 1000, 2, 5, 1, 700]):
        upto = [(sum(sizes[: i + 1]),) for i in range(len(sizes))]
        prefix = spark.createDataFrame(upto, "upto long").coalesce(1)
        got = sharding.smallest_capacity(prefix, sum(sizes), max(sizes), 3, trials=15)[0]
        assert got == brute_capacity(sizes, 3)


def test_empty_table_and_one_hot_text(spark, no_docs):
    assert sharding.shard(no_docs).count() == 0
    docs = make_docs(spark, [(i, "same", "a") for i in range(50)])
    got = sharding.shard(docs, rows_per_piece=7).collect()
    assert {r["shard"] for r in got} == {0} and sorted(r["slot"] for r in got) == list(range(50))
