from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest

from souk.llm import registry, substrings

from .conftest import SF, as_rows, make_docs, pairs


def brute(rows, length=20):
    least = -(2**63)
    first = {}
    texts = [(least if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    for order, _, words in texts:
        for s in range(len(words) - length + 1):
            key = tuple(words[s : s + length])
            first[key] = min(first.get(key, (order, s)), (order, s))
    out = Counter()
    for order, i, words in texts:
        gone = set()
        for s in range(len(words) - length + 1):
            if (order, s) > first[tuple(words[s : s + length])]:
                gone.update(range(s, s + length))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
        out[i, len(words), len(gone), kept] += 1
    return out


@pytest.mark.parametrize("length, gram", [(20, 6), (5, 2), (8, 8)])
def test_odd_rows(odd, length, gram):
    got = substrings.dedup_substrings(odd, length=length, gram=gram)
    want = brute(pairs(odd), length)
    assert Counter(as_rows(got)) == want
    assert sum(k[2] for k in want) > 50


def test_blocks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_BLOCK", 64)
    text = " ".join(f"w{i % 150}" for i in range(700))
    docs = make_docs(spark, [(1, text, "a"), (2, text[50:], "a"), (3, "z " + text, "b"), (4, "same " * 100, "b")])
    assert Counter(as_rows(substrings.dedup_substrings(docs))) == brute(pairs(docs))


def equal_crc(make):
    """Two different texts of ``make(i)`` with equal CRC-32."""
    seen = {}
    for i in range(10**6):
        text = make(i)
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text:
            return other, text


def test_texts_of_one_id_with_equal_checksums(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    short, long = equal_crc(lambda i: f"s{i}" if i % 2 else f"{passage} e{i} {passage} {i * 7919}")
    one, two = equal_crc(lambda i: f"{i} {passage} {i * 31}")
    docs = [(1, passage, "a"), (5, short, "a"), (5, long, "a"), (None, one, "a"), (None, two, "b"), (None, short, "b")]
    docs = make_docs(spark, docs)
    assert Counter(as_rows(substrings.dedup_substrings(docs))) == brute(pairs(docs))


def test_a_third_of_the_rows_without_an_id(spark):
    rows = [(r["doc_id"] if i % 3 else None, r["text"], "a") for i, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").collect())]
    docs = make_docs(spark, rows)
    assert Counter(as_rows(substrings.dedup_substrings(docs))) == brute(pairs(docs))


def test_query(spark, documents):
    want = Counter()
    for (i, n, d, kept), c in brute(pairs(documents)).items():
        want[i, n, d, hashlib.sha256(kept.encode()).hexdigest()] += c
    assert Counter(as_rows(registry.op10_substrings(spark, SF))) == want


def test_empty_table(no_docs):
    assert substrings.dedup_substrings(no_docs).count() == 0
