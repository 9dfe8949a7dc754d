from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from souk.llm import mixing, registry

from .conftest import SF, as_rows, make_docs, odd_rows


def brute_targets(sizes: dict) -> dict:
    """Shares are reshared until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / free for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s]}
        if not over - capped:
            return target
        capped |= over


def check(rows, got):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    target = brute_targets(sizes)
    by = {(sizes[s], round(target[s], 6)): s for s in sizes}
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, words(t)) for i, t, _ in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        source = by[r["source_size"], round(r["target"], 6)]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * largest[s] + 1e-6
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))


def test_odd_rows(odd):
    check(odd_rows(), mixing.mix(odd).collect())


def test_documents(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    check(rows, mixing.mix(documents).collect())


def test_reruns_agree_whatever_the_partitions(odd):
    first = Counter(as_rows(mixing.mix(odd)))
    assert first == Counter(as_rows(mixing.mix(odd.repartition(7))))


def test_query_columns(spark):
    got = registry.op2_mixing(spark, SF)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    kinds = dict(got.dtypes)
    assert kinds["target"] == "double" and kinds["taken"] == kinds["size"] == "bigint"


def test_empty_table_and_no_words(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0
    got = mixing.mix(make_docs(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert [(r["target"], r["taken"]) for r in got] == [(0.0, 0), (0.0, 0)]
