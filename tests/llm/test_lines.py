from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from souk.llm import lines, registry

from .conftest import SF, as_rows, pairs


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate(lower)
    least = -(2**63)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(least if i is None else i)
    out = Counter()
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = []
        for line in all_lines:
            held = holders.get(key(line), ())
            if len(held) < 3 or max(held) == (least if i is None else i):
                kept.append(line)
        out[i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("keys, copies", [(1 << 16, 1 << 20), (8, 3), (1, 1)])
def test_odd_rows(odd, keys, copies):
    got = lines.dedup_lines(odd, keys_per_shard=keys, probes_per_copy=copies)
    want = brute(pairs(odd))
    assert Counter(as_rows(got)) == want
    assert sum(k[2] for k in want) > 5


def test_query(spark, documents):
    want = Counter()
    for (i, n, d, kept), c in brute(pairs(documents)).items():
        want[i, n, d, hashlib.sha256(kept.encode()).hexdigest()] += c
    assert Counter(as_rows(registry.op5_line_dedup(spark, SF))) == want


def test_empty_table(no_docs):
    assert lines.dedup_lines(no_docs).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    sizes, words = lines.build(keys)
    assert sorted(lines.places(keys, sizes, words)) == list(range(len(keys)))
    assert lines.places(np.zeros(0, np.uint64), *lines.build(np.zeros(0, np.uint64))).tolist() == []
