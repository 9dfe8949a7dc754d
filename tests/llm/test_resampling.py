from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from souk.llm import registry, resampling

from .conftest import SF, as_rows, make_docs, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(words, most):
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, most=1, buckets=10000, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in grams(cut(t), most))
    t = Counter(bucket(f) for x in target for f in grams(cut(x), most))
    alls, allt = s.total() + buckets, t.total() + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * alls / ((s[b] + 1) * allt))) for b in s}
    rows = []
    for i, text in docs:
        words = cut(text)
        found = grams(words, most)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, len(words) >= least, zlib.crc32((text or "").encode())])
    long = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], -(2**63) if r[0] is None else r[0], r[6]))
    for rank, r in enumerate(long[: percent * len(long) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in rows)


TARGET = ["The quick word of λόγος, don't", None, "", "quick QUICK 12 3.5"]


def targets(spark, texts=TARGET):
    return make_docs(spark, [(i, t, "b") for i, t in enumerate(texts)])


@pytest.mark.parametrize("most,percent,least", [(1, 10, 20), (3, 50, 1), (2, 100, 0)])
def test_odd_rows(spark, odd, most, percent, least):
    docs = [(i, t) for i, t, _ in odd_rows()]
    got = resampling.resample(odd, targets(spark), most=most, percent=percent, least_words=least)
    assert Counter(as_rows(got)) == brute(docs, TARGET, most, 10000, least, percent)


def test_few_buckets_and_no_target(spark, odd):
    docs = [(i, t) for i, t, _ in odd_rows()]
    got = resampling.resample(odd, targets(spark, []), buckets=7)
    assert Counter(as_rows(got)) == brute(docs, [], 1, 7)


def test_hot_text_and_rows_without_an_id(spark):
    docs = [(None, "one text that many rows share " * 5) for _ in range(60)]
    docs += [(None if i % 2 else i, f"text number {i} of its own " * 5) for i in range(60)]
    rows = make_docs(spark, [(i, t, "x") for i, t in docs])
    assert Counter(as_rows(resampling.resample(rows, targets(spark), percent=40))) == brute(docs, TARGET, percent=40)


def test_empty_table(spark, no_docs):
    got = resampling.resample(no_docs, targets(spark))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and got.collect() == []


def test_spans_change_nothing():
    text = ("Ünder the quick-brown λόγος 日本語日本語日本語 x " * 40 + "y" * 200 + " end").encode()
    for most in (1, 2, 4):
        whole = resampling.features(text, most)
        assert whole[0] == len(cut(text.decode()))
        assert whole[1] == Counter(zlib.crc32(g.encode()) for g in grams(cut(text.decode()), most))
        for span in (1, 2, 7, 50, 333):
            assert resampling.features(text, most, span) == whole


def test_query_and_its_sql(spark):
    got = registry.QUERIES["op12_resampling"](spark, SF)
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs = [tuple(r) for r in read("documents").select("doc_id", "text").collect()]
    rows = Counter(as_rows(got))
    assert rows == brute(docs, [r["text"] for r in read("benchmark").select("text").collect()])
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert Counter(con.sql(registry.ORACLES["op12_resampling"]).fetchall()) == rows
