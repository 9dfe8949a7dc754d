from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
import pytest


from souk.llm import mixing, pipeline, registry
from souk.llm.common import staged

from .conftest import SF, make_docs
from .test_lines import brute as brute_lines
from .test_simhash import expected as brute_groups

SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(staged(stage(spark, seen[-1], SF_ORACLE), f"test-{name}"))
    return seen


def whole(df):
    return Counter(tuple(r) for r in df.collect())


def test_columns_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "bpe"]


def test_stages_keep_the_columns(stages):
    for a, b in zip(stages[:-2], stages[1:-1]):
        assert a.dtypes == b.dtypes


def test_toxic_documents_go(spark, stages):
    docs, clean = stages[:2]
    assert not whole(clean) - whole(docs)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_ORACLE}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in clean.collect()}
    gone = [labels[r["doc_id"]] for r in docs.collect() if r["doc_id"] in labels and r["doc_id"] not in kept]
    assert sum(gone) >= 0.8 * sum(labels.values()) and sum(gone) >= 0.95 * len(gone)


def test_lines_go(stages):
    before, after = stages[1:3]
    want = Counter()
    for (i, _, _, kept), c in brute_lines([(r["doc_id"], r["text"]) for r in before.collect()]).items():
        want[i, kept] += c
    assert Counter((r["doc_id"], r["text"]) for r in after.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_one_document_of_each_group_stays(stages):
    before, after = stages[2:4]
    groups = brute_groups([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, _, c in groups})
    assert not whole(after) - whole(before)


def test_mixed_copies_are_encoded(stages):
    deduped, mixed, encoded = stages[3:]
    counts = whole(mixed)
    assert set(counts) <= set(whole(deduped)) and max(counts.values()) <= 3
    assert encoded.count() == mixed.count()
    assert Counter(r["doc_id"] for r in encoded.collect()) == Counter(r["doc_id"] for r in mixed.collect())


def test_decoded_bytes_are_the_texts(spark, odd):
    out = pipeline.bpe_stage(spark, odd, SF)
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = Counter((r["doc_id"], r["decoded_sha256"]) for r in out.collect())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert got == Counter((r["doc_id"], sha(r["text"])) for r in odd.collect())


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF_ORACLE)
    cols = ["doc_id", "n_tokens", "ids_sha256"]
    assert whole(got.select(*cols)) == whole(stages[-1].select(*cols))
    assert registry.QUERIES["pipeline"] is corpus_pipeline.run


def test_odd_rows_and_clashing_columns(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == odd.columns
        docs = staged(out, "test-odd")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count() > 0


def test_each_stage_on_an_empty_table(spark, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0


def test_repeated_and_null_ids_leave_one_document(spark):
    rows = [(4, "same text here", "a"), (4, "same text here", "a"), (None, "same text here", "a"), (None, "other words", "b"), (None, "other words", "b")]
    got = pipeline.simhash_stage(spark, make_docs(spark, rows), SF)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, "other words"), (4, "same text here")]


def test_alike_rows_are_mixed_like_others(spark):
    rows = [(4, "some words of a text", "a")] * 30 + [(None, "others", "b")] * 20 + [(i, "x " * i, "b") for i in range(10)]
    docs = staged(make_docs(spark, rows), "test-alike")
    got = whole(pipeline.mixing_stage(spark, docs, SF))
    want = Counter()
    mixed = mixing.mix(docs.select("doc_id", "text", "source"), carry="text")
    for r in mixed.filter("copies > 0").collect():
        want[r["doc_id"], r["text"]] += r["copies"]
    assert Counter({(k[0], k[1]): c for k, c in got.items()}) == want


def test_all_ids_null(spark):
    docs = make_docs(spark, [(None, f"text {i % 40} of " + "some words " * (i % 7), "hot") for i in range(120)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), "test-null")
    assert docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
