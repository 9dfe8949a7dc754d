from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from souk.llm import fingerprints, registry

from .conftest import SF, make_docs, odd_rows


def shingles(text, k=5):
    words = (text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def true_likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, got):
    """rows: (doc_id, text) with distinct ids, or repeated rows."""
    text = dict(rows)
    order = sorted(text, key=lambda i: (i is None, -(i or 0)))
    following = {a: b for a, b in zip(order, order[1:] + order[:1])}
    seen = {}
    for r in got:
        own, nxt = text[r["doc_id"]] or "", text[following[r["doc_id"]]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(own, r["fingerprint"]) == r["fingerprint"]
        for value, want in ((r["near_edited"], true_likeness(own, edited)), (r["near_next"], true_likeness(own, nxt))):
            exact = max(len(shingles(own)), len(shingles(edited)), len(shingles(nxt))) < fingerprints.K // 2
            assert abs(value - want) <= (1e-9 if exact else 0.2)
        n = len(shingles(own))
        assert r["distinct_shingles"] == pytest.approx(n, rel=0.4)


def test_documents(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = registry.op3_fingerprints(spark, SF).collect()
    assert len(got) == len(rows)
    check(rows, got)


def test_odd_rows(spark):
    rows, used = [], set()
    for i, t, s in odd_rows():
        if i is not None and i not in used:
            used.add(i)
            rows.append((i, t, s))
    rows.append((None, "one row without an id", "a"))
    got = fingerprints.fingerprint(make_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    check([(i, t) for i, t, _ in rows], got)


def test_repeated_rows_and_ids_and_no_ids(spark, odd):
    assert fingerprints.fingerprint(odd).count() == odd.count()
    docs = make_docs(spark, [(None, "a b", "x"), (None, "c d", "x"), (None, None, "x")])
    assert fingerprints.fingerprint(docs).count() == 3
    one = fingerprints.fingerprint(make_docs(spark, [(1, "a b c d", "x")])).first()
    assert one["near_next"] == 1.0


def test_empty_table(no_docs):
    assert fingerprints.fingerprint(no_docs).count() == 0


def test_sketches_of_parts_merge(spark):
    words = [f"w{i % 37}x{i // 3}" for i in range(900)]
    parts = [" ".join(words[a : a + 304]) for a in range(0, 900, 300)]
    whole = spark.createDataFrame([(1, " ".join(words))], "k int, t string")
    whole = fingerprints.with_sketch(whole, "t", "s").first()["s"]
    df = fingerprints.with_sketch(spark.createDataFrame([(1, p) for p in parts], "k int, t string"), "t", "s")
    assert fingerprints.merge_parts(df.select("k", "s"), ["k"], "s").first()["s"] == whole
    both = df.orderBy("t").agg(F.first("s").alias("a"), F.last("s").alias("b"))
    merged = both.select(fingerprints.merge(F.col("a"), F.col("b")).alias("m"), "a", "b").first()
    assert merged["m"] == sorted(set(merged["a"]) | set(merged["b"]))[: fingerprints.K]


def test_no_python_in_the_plan(spark):
    plan = registry.op3_fingerprints(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
