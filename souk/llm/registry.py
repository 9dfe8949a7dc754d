"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm import (
    bpe,
    fingerprints,
    lines,
    mixing,
    neighbours,
    packing,
    pipeline,
    resampling,
    secrets,
    sharding,
    simhash,
    substrings,
    toxicity,
    whitening,
)
from souk.llm.common import sha256_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = bpe.vocabulary(spark, pipeline.VOCABULARY, public_tokenizers.PATTERN)
    return bpe.digests(bpe.encode(_table(spark, sf_dir, "documents"), shared), shared)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("copies")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256_of(F.col("kept")).alias("kept_sha256"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("_id") % 20 == 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", sha256_of(F.col("kept")).alias("kept_sha256"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = packing.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(_table(spark, sf_dir, "documents"), shared)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_fingerprints": op3_fingerprints,
    "op4_sharding": op4_sharding,
    "op5_line_dedup": op5_line_dedup,
    "op6_neighbours": op6_neighbours,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_secrets": op9_secrets,
    "op10_substrings": op10_substrings,
    "op11_packing": op11_packing,
    "op12_resampling": op12_resampling,
    "op13_whitening": op13_whitening,
}

# The other operators have no SQL form in the comparing engine (its functions
# lack XXH64, CRC-32, the tokenizer, learned models); tests hold them against
# brute force.
ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op5_line_dedup": lines.ORACLE,
    "op10_substrings": substrings.ORACLE,
    "op12_resampling": resampling.ORACLE,
}
