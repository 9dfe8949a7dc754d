from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from souk.llm import registry, toxicity

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_query_on_held_out_labels(spark):
    got = registry.op8_toxicity(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in got.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    pairs = [(rows[x["doc_id"]]["predicted"], x["toxic"]) for x in labels if rows[x["doc_id"]]["held_out"]]
    assert len(pairs) > 50 and np.mean([a == b for a, b in pairs]) >= 0.95
    assert sum(a for a, b in pairs if b) >= 0.5 * sum(b for _, b in pairs)


def test_held_out_labels_are_never_seen(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn(
        "toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    a, b = toxicity.train(docs, labels, epochs=1), toxicity.train(docs, flipped, epochs=1)
    assert a.bias == b.bias and (a.w == b.w).all() and (a.v == b.v).all()


def test_pairs_that_only_together_are_toxic():
    """Either word alone is harmless: no sum of word weights tells them apart."""
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for _ in range(1200):
        words = [f"w{k}" for k in rng.integers(0, 30, 5)]
        insult, group = rng.integers(0, 2, 2)
        words += ["insulting"] * insult + ["harmless"] * (1 - insult)
        words += ["groupname"] * group + ["nobody"] * (1 - group)
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        labels.append(int(insult == group))
    machine = toxicity.fit(texts[:900], labels[:900], buckets=1 << 12, epochs=30)
    right = [(machine.score(t) >= 0.5) == y for t, y in zip(texts[900:], labels[900:])]
    assert np.mean(right) >= 0.95


@pytest.mark.parametrize("length", [100, 300, 2000])
def test_pairs_keep_their_weight_on_long_texts(length):
    """Production settings; the pair's words stand anywhere in the text."""
    rng = np.random.default_rng(4)
    texts, labels = [], []
    for _ in range(1700):
        words = [f"w{k}x" for k in rng.zipf(1.3, length) % (10 * length)]
        insult, group = rng.integers(0, 2, 2)
        words += ["insulting"] * insult + ["harmless"] * (1 - insult)
        words += ["groupname"] * group + ["nobody"] * (1 - group)
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        labels.append(int(insult == group))
    machine = toxicity.fit(texts[:1400], labels[:1400])
    right = [(machine.score(t) >= 0.5) == y for t, y in zip(texts[1400:], labels[1400:])]
    assert np.mean(right) >= 0.95


def test_odd_rows_and_labels(spark, odd, no_docs):
    labels = spark.createDataFrame(
        [(20, 1, 1), (20, 1, 0), (21, 1, 0), (22, 0, None), (None, 1, 1), (23, 1, 1), (24, 1, 0), (26, 0, 0)], LABELS
    )
    machine = toxicity.train(odd, labels)
    got = toxicity.score(odd, machine).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert toxicity.score(no_docs, machine).count() == 0
    assert toxicity.train(odd, spark.createDataFrame([], LABELS)) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}
