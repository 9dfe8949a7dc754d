from __future__ import annotations

import base64
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from souk.llm import bpe, registry

from .conftest import SF, as_rows, make_docs, pairs

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def shared(spark):
    return bpe.vocabulary(spark, PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(rows, encoding):
    out = Counter()
    for i, text in rows:
        ids = encoding.encode_ordinary(text or "")
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        out[i, len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("chunk, overlap", [(30, 10), (64, 16), (400, 100), (16384, 512)])
def test_odd_texts_by_any_chunk(odd, shared, encoding, chunk, overlap):
    got = bpe.digests(bpe.encode(odd, shared, chunk_chars=chunk, overlap_chars=overlap), shared)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(as_rows(got)) == expected(pairs(odd), encoding)


def test_query(spark, documents, encoding):
    got = registry.op1_bpe(spark, SF)
    assert Counter(as_rows(got)) == expected(pairs(documents), encoding)


def test_a_run_longer_than_the_overlap_is_one_piece(spark, shared, encoding):
    docs = make_docs(spark, [(1, "ab cd " * 20 + "z" * 200 + " ef gh" * 40, "a"), (2, " " * 500, "a")])
    got = bpe.digests(bpe.encode(docs, shared, chunk_chars=60, overlap_chars=20), shared)
    assert Counter(as_rows(got)) == expected(pairs(docs), encoding)


def test_chunks_are_stitched_and_cut(spark, shared):
    text = "some words to cut apart, again and again " * 100
    docs = spark.createDataFrame([("k", text)], "key string, text string")
    chunks = bpe.cut(docs, 300, 60)
    cuts = bpe.stitches(bpe.boundaries(chunks, shared, 60)).orderBy("chunk").collect()
    assert len(cuts) == chunks.count() > 10
    assert all(r["cut"] is not None and r["piece"] == r["chunk"] for r in cuts)


def test_empty_table(no_docs, shared):
    assert bpe.digests(bpe.encode(no_docs, shared), shared).count() == 0


def test_ids_decode_to_bytes(odd, shared):
    back = bpe.decode(bpe.encode(odd, shared), shared).select("doc_id", F.col("bytes").cast("string"))
    assert Counter(as_rows(back)) == Counter((i, t or "") for i, t in pairs(odd))
