"""The stages of the corpus pipeline.

A stage takes (spark, docs, sf_dir). All but the last return the columns of
``docs``, whatever those are. Texts don't travel with decisions: near-dedup and
mixing decide on a key of the row's content and a few numbers, and each decision
meets the rows in one join (broadcast by Spark where the written decisions are
small, by a shuffle of the rows beyond).

1. toxicity: documents with a score of at least 0.5 go;
2. line dedup: the text loses its repeated lines (``n_chars`` follows, if there);
3. SimHash near-dedup: one document of each group stays, that of the smallest id
   (a repeated id: the first by fingerprint and key);
4. mixing: each document is repeated as often as the mix takes it;
5. byte-level BPE: ids of every text, decoded again; digests of the ids and of the
   decoded bytes.

Null ids and texts, empty texts, repeated rows and empty tables go through every
stage as the operators define. Rows that are alike in every column share a key:
near-dedup keeps one of them, mixing repeats one of them as often as it takes
them all.

The stages that call Python lower the session's Arrow batches from Spark's default of
64 MB of rows to 4 MB: a batch is held by the JVM's vectors and by the worker at once, twice
over while they grow, for each task of an executor. A limit the session set itself stays.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm import bpe, lines, mixing, simhash, toxicity
from souk.llm.common import KEY, row_key, staged

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

_BATCH, _SPARKS_OWN, _BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def _small_batches(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(_BATCH, None) == _SPARKS_OWN:
            spark.conf.set(_BATCH, _BYTES)
        return stage(spark, docs, sf_dir)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """The key of each row beside the whole row, packed: no names can clash."""
    return docs.select(*row_key(docs), F.struct("*").alias("_row"))


def _unpacked(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    return rows.select(*(changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


@_small_batches
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.scorer(spark, machine)(F.col("text")) < 0.5)


@_small_batches
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the operator gives the text back, so the row travels without it
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("_null"), *rest).alias("_row"))
    out = lines.dedup_lines(rows, carry="_row")
    text = F.when(~F.col("_row._null") | (F.col("kept") != ""), F.col("kept"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept").cast(kind)).otherwise(F.col("_row")["n_chars"])
    return _unpacked(out, docs, **changed)


@_small_batches
def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(docs.select("doc_id", "text", *row_key(docs)), carry=KEY)
    keys = staged(
        found.groupBy(*KEY).agg(
            F.min("root").alias("root"),
            F.min("fp").alias("fp"),
            F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("first"),
            F.count(F.lit(1)).alias("n"),
        ),
        "pipeline-groups",
    )
    kept = keys.filter("first").groupBy("root").agg(F.min(F.struct("fp", *KEY, "n")).alias("one")).select("one.*")
    rows = _keyed(docs)
    # what goes is the smaller side; alike rows are settled apart
    gone = keys.join(kept.filter("n = 1"), KEY, "left_anti").select(*KEY)
    out = rows.join(staged(gone, "pipeline-gone"), KEY, "left_anti")
    again = staged(kept.filter("n > 1").select(*KEY), "pipeline-alike")
    if not again.isEmpty():
        out = out.unionByName(_one_each(rows.join(again, KEY, "left_semi")))
    return _unpacked(out, docs)


def _one_each(rows: DataFrame, *also: str) -> DataFrame:
    firsts = (F.first(c).alias(c) for c in ("_row", *also))
    return rows.groupBy(*KEY).agg(*firsts)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.struct(*row_key(docs)).alias("_key")
    mixed = mixing.mix(docs.select("doc_id", "text", "source", key), carry="_key")
    taken = staged(
        mixed.groupBy(*(F.col("_key")[k].alias(k) for k in KEY))
        .agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
        .filter("copies > 0"),
        "pipeline-taken",
    )
    rows = _keyed(docs)
    out = rows.join(taken.filter("n = 1").drop("n"), KEY)
    again = taken.filter("n > 1")
    if not again.isEmpty():
        out = out.unionByName(_one_each(rows.join(again.drop("n"), KEY), "copies"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return _unpacked(out.select("_row", copies.alias("copy")), docs)


@_small_batches
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256)."""
    shared = bpe.vocabulary(spark, VOCABULARY, public_tokenizers.PATTERN)
    decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    # written between: a task that encodes and decodes at once has two Python workers
    encoded = staged(bpe.encode(docs, shared), "pipeline-ids")
    return bpe.decode(encoded, shared).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]
